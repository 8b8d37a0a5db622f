"""Source divergence audit: triangular divergence of term distributions within a language, by count-level bitmaps.

Terms are runs of letters (`[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`: ASCII letters and all signs beyond ASCII; only A-Z
are lower-cased). A language keeps the V terms that occur in at least `least` of its documents. Each group
(language, source), and each language, gives each kept term p = 1 + floor(10^9 * (count + 2) / (N + 2V)), N the
sum of its counts. Two distributions differ at a term by f = floor((p - q)^2 / (p + q)); the audit sums f over all kept terms
for each pair of sources, and lists for each group the terms that it has more often than its language.

Kept terms of a language are numbered from the most frequent down, 64 to a word. For each group and count there
is a bitset of the terms with that count, in the words where it has any. Of two groups, AND and popcount of the bitsets
of a word give how many of its terms have each pair of counts (the joint cells), and these are multiplied by f of the pair.
Zero counts have no bitsets; their cells follow by complement: with f(a, 0), f(0, b) and f(0, 0) taken for all terms of
a bitset, whatever the other group has there, a joint cell is left with f(a, b) - f(a, 0) - f(0, b) + f(0, 0).

All is whole numbers: p, f and their sums over V terms stay below 2^63 while V stays below 10^9.

Nulls of text, language and source are read as ''. Each row is a document, repeated ones count again; texts are read
whole, in stretches. A group without kept terms, or without any, has N = 0 and p as of zero counts; in a language without kept terms
all values are 0. Ties are ranked by the item's UTF-8 bytes. An empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import pieces, spans, texts, written

#: Maps bytes to themselves, A-Z to a-z, and all that is in no term to a space.
TERMS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and entries that a task holds before it passes them on.
STRETCH, HELD = 1 << 20, 200_000
#: Bitset words that one group of a task meets, about; numbers of a matrix that are worked on at a time.
WORDS, CELLS = 200_000, 1 << 21
#: Sources whose pairs one group of a task sums: a matrix of so many rows and one column a source.
TILE = 1024


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """A text of spaces and terms in pieces that end at spaces."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group; and of each group a row without a term."""
    named = docs.select(F.coalesce(lang, F.lit("")).alias("l"), F.coalesce(source, F.lit("")).alias("s"), F.col(text).alias("t"))

    def rows(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (l, s), (n, d) in held.items():
            terms = [None, *n]
            size = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * size, pa.string()), pa.array([s] * size, pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[x] for x in n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in pieces(batches, "t"):
            for l, s, t in zip(batch.column("l").to_pylist(), batch.column("s").to_pylist(), texts(batch.column("t"))):
                n, d = held.setdefault((l, s), (Counter(), Counter()))
                seen: set[bytes] = set()
                for piece in stretches(t.translate(TERMS)):
                    found = piece.split()
                    n.update(found)
                    seen.update(found)
                d.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    parts = named.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, size: Column, terms: Column) -> Column:
    """p of a count; null where the language has no kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * wide(n + 2), wide(size + 2 * terms))
    return F.when(terms > 0, whole.cast("bigint") + 1)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def apart_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def met(levels: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of f over pairs of sources (a, b), a in this tile, b behind a; without f(0, 0) of terms that none of the two has.

    levels(no, block, bits, p), groups(no, p0, mine): sources of the language, numbered in any order.
    """
    none = pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
    if not levels.num_rows or not groups.num_rows:
        return none
    no, p0, mine = (groups.column(c).to_numpy() for c in ("no", "p0", "mine"))
    order = np.argsort(no)
    no, p0, mine = no[order], p0[order].astype(np.int64), mine[order]
    first, many = int(np.argmax(mine)), int(mine.sum())
    out = np.zeros((many, len(no)), np.int64)
    own, block, bits, p = (levels.column(c).to_numpy() for c in ("no", "block", "bits", "p"))
    at = np.searchsorted(no, own)
    order = np.lexsort((at, block))
    at, block, bits, p = at[order], block[order], bits[order].view(np.uint64), p[order].astype(np.int64)
    tile = (at >= first) & (at < first + many)
    zero = apart_of(p0[first : first + many, None], p0[None, :])

    # f(a, 0) and f(0, b) of all terms of a bitset, less f(0, 0): one term's, for each group and p once.
    key, back = np.unique(at.astype(np.int64) << 31 | p, return_inverse=True)  # p < 2^30 + 2
    n = np.bincount(back, np.bitwise_count(bits)).astype(np.int64)  # far below 2^53
    x_of, p_of = key >> 31, key & ((1 << 31) - 1)
    step = max(1, CELLS // len(no))
    for c in range(0, len(n), step):
        x, px, nx = x_of[c : c + step], p_of[c : c + step], n[c : c + step]
        here = (x >= first) & (x < first + many)
        np.add.at(out, x[here] - first, nx[here, None] * (apart_of(px[here, None], p0[None, :]) - zero[x[here] - first]))
        np.add.at(out.T, x, nx[:, None] * (apart_of(px[:, None], p0[None, first : first + many]) - zero[:, x].T))

    cuts = spans(np.unique(block, return_counts=True)[1])
    for a, b in zip(cuts, cuts[1:]):
        left = a + np.flatnonzero(tile[a:b])
        step = max(1, CELLS // (b - a))
        for c in range(0, len(left), step):
            rows = left[c : c + step]
            joint = bits[rows, None] & bits[None, a:b]
            i, j = np.nonzero(joint)
            i, j, cells = rows[i], a + j, np.bitwise_count(joint[i, j]).astype(np.int64)
            behind = at[j] > at[i]
            i, j, cells = i[behind], j[behind], cells[behind]
            x, y = at[i], at[j]
            f = apart_of(p[i], p[j]) - apart_of(p[i], p0[y]) - apart_of(p0[x], p[j]) + zero[x - first, y]
            np.add.at(out, (x - first, y), cells * f)
    i, j = np.nonzero(np.arange(len(no))[None, :] > np.arange(first, first + many)[:, None])
    return pa.table({"lang": pa.array([levels.column("lang")[0].as_py()] * len(i), pa.string()), "a": no[first + i], "b": no[j], "value": out[i, j]})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, each other source of the language with the sum of f; part term, the group's `top` terms."""
    counts = written(term_counts(docs, text, lang, source))
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("_d")).where(F.col("_d") >= least).drop("_d")
    # Numbers that are fixed once written; words hold terms of like frequency, so few counts a group.
    ids = written(kept.repartitionByRange("lang", F.desc("of_lang"), "term").sortWithinPartitions("lang", F.desc("of_lang"), "term").withColumn("id", F.monotonically_increasing_id()))
    cells = written(counts.where("n > 0").drop("docs").join(ids, ["lang", "term"]))
    langs = ids.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_size"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    groups = groups.withColumns({"p0": share(F.lit(0), F.col("size"), F.col("terms")), "no": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1})
    groups = written(groups)

    p = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size"), F.col("terms")))
    q = share(F.col("of_lang"), F.col("lang_size"), F.col("terms"))
    terms = p.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    levels = p.groupBy("lang", "no", F.shiftright("id", 6).alias("block"), "n", "p").agg(F.bit_or(bit).alias("bits")).drop("n")
    levels = written(levels)
    shape = levels.groupBy("lang").agg((F.count("*") / WORDS + 1).cast("bigint").alias("slices"))
    tiles = groups.groupBy("lang").agg(F.floor((F.count("*") - 1) / TILE).alias("last"))
    shape = shape.join(tiles, "lang")
    each_tile = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("tile")
    left = levels.join(shape, "lang").select("lang", F.expr("pmod(xxhash64(block), slices)").alias("slice"), each_tile, "no", "block", "bits", "p")
    right = groups.join(shape, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), "no", "p0", "last")
    right = right.select("lang", "slice", each_tile, "no", "p0").withColumn("mine", F.floor(F.col("no") / TILE) == F.col("tile"))
    keys = ["lang", "slice", "tile"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, "lang string, a long, b long, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("sum"))

    side = lambda c: groups.select("lang", "terms", F.col("no").alias(c), F.col("source").alias(f"source_{c}"), F.col("p0").alias(f"p_{c}"))
    pairs = side("a").join(side("b").drop("terms"), "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("terms") * apart(F.col("p_a"), F.col("p_b")), F.lit(0)) + F.coalesce("sum", F.lit(0))
    pairs = pairs.withColumn("value", value.cast("bigint"))
    both = pairs.select("lang", F.inline(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))), "value")
    ranked = both.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return ranked.unionByName(terms)
