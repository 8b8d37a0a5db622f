"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Fingerprints: A-Z are lower-cased, words are runs of other characters than space, tab, line feed,
vertical tab, form feed and carriage return; each shingle's XXH64 (seed 42) votes on every bit, and
a bit is set that over half of the shingles set. Fewer words than a shingle has make one shingle;
a text without words (null, empty, white space) has fingerprint zero and is linked like any other.

Links: equal fingerprints are one node. Nodes are posted in an inverted index of positional bytes,
in lists for each choice of two of the four byte couples: two fingerprints with at most two
differing bits have at least six of eight positional bytes in common, hence two couples, hence a
list. For each pair of a list the shared positional bytes are tallied, pairs with six or more
retained and verified bit by bit. A list of over SHORT nodes would give too many pairs, so its nodes
are linked exactly another way, in work proportional to their number: two fingerprints differ in at
most two bits if and only if some 64-bit value lies within one bit of both, so each node is grouped
under the 65 values within one bit of it, and each group (65 nodes at most) is linked to its smallest.

Likeness of 0.8: of shingle sets that alike about 15 % of all fingerprint bits differ, which no number
of differing bits of a short fingerprint tells from other texts. And where shingles vote as often as
they occur, a passage repeated through more than half of a text decides all bits. So
drop_near_duplicates has fingerprints of distinct shingles and a node for each set of these, whatever
its fingerprint, and links in steps, each link verified by the two nodes' whole sets. First as above,
and within equal fingerprints to the least node. Then, of every group found, one node goes on, with WIDE further
positional bytes made by the same vote from other bits; postings are for TRIPLES of these, at
each of which such a pair agrees with a chance of a fiftieth or more. In a list each member is paired with the next one that differs from it in at most
LOOSE bits of the first fingerprint, which links most of what is alike without making all pairs of a
crowded list. Last, in lists of three or more, all pairs of different groups are tried that differ in
at most LOOSE bits and in at most CLOSE of the further ones. So pairs of 0.8 are found with a chance
of about nine in ten and more alike ones almost surely (see README); what is found is exact.

Repeated rows, nulls and very long texts are rows like others (texts are read whole); an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import buckets, fresh, given_back, pieces, spans, texts, written
from vigil.llm.graph import components

SHORT = 64
#: Further positional bytes of a fingerprint, and the triples of their places that have lists: no two places are together in two.
WIDE = 64
TRIPLES = np.array([[(i + d) % WIDE for d in step] for step in ((0, 1, 3), (0, 5, 12)) for i in range(WIDE)])
#: Differing bits, of 64 and of 8 * WIDE, up to which a pair of such a list is verified.
LOOSE, CLOSE = 14, 100
#: Bytes of text that are profiled, and nodes that are posted, at a time.
PIECE, POSTED = 1 << 19, 2048
#: Pairs up to which their fingerprints (two of 8 bytes each) are sent to all tasks.
SENT = 1_000_000
#: For each byte, its bits in eight lanes of a byte each.
LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1) << (8 * np.arange(8))).sum(axis=1).astype("<u8")


def shingle_hashes(text: bytes, words: int) -> list[int]:
    found = text.lower().split()  # bytes: A-Z and the six white-space bytes only
    if not found:
        return []
    runs = zip(*(found[n:] for n in range(words))) if len(found) >= words else [found]
    return [xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs]


def majority(hashes: list[list[int]] | list[np.ndarray]) -> np.ndarray:
    """For each list of hashes the bits set in over half of them; zero for an empty list."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    if isinstance(hashes[0], np.ndarray) if hashes else False:
        flat = np.concatenate(hashes).astype("<u8")
    else:
        flat = np.fromiter((h for x in hashes for h in x), "<u8", sizes.sum())
    return voted(flat, sizes)


def voted(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """majority() of hashes laid end to end."""
    out = np.zeros(len(sizes), "<u8")
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    at = spans(sizes)
    chunks = -(-sizes // 255)  # a lane holds a count of up to 255
    first = np.repeat(at[:-1], chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(spans(chunks)[:-1], chunks))
    lanes = np.add.reduceat(LANES[flat.view(np.uint8).reshape(-1, 8)], first, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(first), 64).astype(np.int64), spans(chunks)[:-1], axis=0)
    bits = (2 * counts > sizes[:, None]).astype("<u8") << np.arange(64, dtype="<u8")
    out[full] = np.bitwise_or.reduce(bits, axis=1)
    return out


def remixed(flat: np.ndarray, n: int) -> np.ndarray:
    """The n-th other 64 bits of each hash."""
    x = (flat ^ np.uint64(0x9E3779B97F4A7C15 * (n + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, name: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a long; other columns pass through."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = majority([shingle_hashes(x, words) for x in texts(batch.column(text))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def _byte(value: Column, n: int) -> Column:
    return F.shiftrightunsigned(value, 8 * n).bitwiseAND(F.lit(255))


def links(nodes: DataFrame, most: int = 2) -> DataFrame:
    """nodes(f): distinct fingerprints. Returns (a, b), links that connect all pairs with at most `most` (1 or 2) differing bits."""
    if most not in (1, 2):
        raise ValueError("links are made for one or two differing bits")
    couple = lambda n: F.shiftrightunsigned("f", 16 * n).bitwiseAND(F.lit(0xFFFF))
    keys = [
        F.struct(F.lit(k).alias("list"), F.shiftleft(couple(x), 16).bitwiseOR(couple(y)).alias("bytes"))
        for k, (x, y) in enumerate(combinations(range(4), 2))
    ]
    posted = nodes.select("f", F.inline(F.array(*keys)))
    sizes = posted.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    posted = written(posted.join(sizes, ["list", "bytes"]).select("list", "bytes", "f", (F.col("n") <= SHORT).alias("short")))
    one = posted.where("short").select("list", "bytes", F.col("f").alias("a"))
    two = posted.where("short").select("list", "bytes", F.col("f").alias("b"))
    shared = sum((F.when(_byte(F.col("a"), n) == _byte(F.col("b"), n), 1).otherwise(0) for n in range(8)), F.lit(0))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    pairs = one.join(two, ["list", "bytes"]).where("a > b").where(shared >= 8 - most).where(near).select("a", "b")
    values = F.array(F.col("f"), *(F.col("f").bitwiseXOR(F.lit(1 << n if n < 63 else -(1 << 63))) for n in range(64)))
    balls = posted.where("not short").select("f").distinct().select("f", F.explode(values).alias("v"))
    groups = balls.groupBy("v").agg(F.collect_set("f").alias("g")).where(F.size("g") > 1)  # 65 at most
    if most == 1:  # then one of the two is the value itself
        groups = groups.where(F.array_contains("g", F.col("v"))).withColumn("m", F.col("v"))
    else:
        groups = groups.withColumn("m", F.array_min("g"))
    stars = groups.select(F.explode("g").alias("a"), F.col("m").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def grouped(marked: DataFrame, most: int) -> DataFrame:
    """marked(k, simhash, ...): adds `component_id`, the smallest k reachable, and `root`, one value for each component."""
    nodes = marked.groupBy(F.col("simhash").alias("f")).agg(F.min("k").alias("least"))
    found = components(links(nodes.select("f"), most)).withColumnRenamed("node", "f")
    rooted = written(nodes.join(found, "f", "left").withColumn("root", F.coalesce("root", "f")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select(F.col("f").alias("simhash"), "root", "component_id"), "simhash")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """(key, simhash, component_id): component_id is the smallest key whose fingerprint is reachable by links.

    Rows are kept one to one; null keys have fingerprints and take their component's smallest key
    (null where a component has no other). Equal keys and texts are rows like others. Fingerprints,
    links and components stay distributed; copies share one node and are never paired.
    """
    marked = written(fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", words).drop("t"))
    return grouped(marked, most).select(F.col("k").alias(key), "simhash", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def profiled(docs: DataFrame, words: int) -> DataFrame:
    """docs(k, t, h, g): without t, with `f` (one value for each set of shingles), `bits` (the fingerprint of distinct shingles), `wide` (WIDE bytes) and `shingles` (32 bits of each distinct one's hash, sorted)."""
    kept = docs.drop("t")
    names = kept.columns
    more = [T.StructField("bits", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("shingles", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", PIECE):
            found = [np.array(shingle_hashes(x, words), "<u8") for x in texts(batch.column("t"))]
            single = [np.unique(x) for x in found]
            flat, sizes = np.concatenate(single), np.array([len(x) for x in single])
            bits = voted(flat, sizes)
            wide = np.stack([voted(remixed(flat, n), sizes) for n in range(WIDE // 8)], axis=1)
            sets = [np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in single]
            out = [pa.array(bits.view(np.int64)), pa.array([x.tobytes() for x in wide], pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + out, names=[*names, "bits", "wide", "shingles"])

    return docs.mapInArrow(given_back(run), T.StructType([*kept.schema.fields, *more])).withColumn("f", F.xxhash64("shingles"))


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) whose sets of shingles have a likeness (shared by all) of `least` or more. sets(f, shingles): rows of one f are equal."""
    pairs = written(pairs)
    need = pairs.select(F.col("a").alias("f")).unionByName(pairs.select(F.col("b").alias("f"))).distinct()
    if pairs.count() <= SENT:
        need = F.broadcast(need)  # so that only the sets asked for move
    own = sets.join(need, "f", "left_semi").groupBy("f").agg(F.any_value("shingles").alias("shingles"))
    side = lambda c: own.select(F.col("f").alias(c), F.col("shingles").alias(f"_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column("_a"), batch.column("_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                few, many = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if few >= least * many else 0
                fine.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b").mapInArrow(given_back(run), "a long, b long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def in_lists(key: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of each list that are near; once: each member's first such partner among those behind it. key: of the list, sorted."""
    here, d, found = np.arange(len(key)), 0, [(np.zeros(0, np.int64),) * 2]
    while len(here):  # members d places apart
        d += 1
        here = here[here + d < len(key)]
        here = here[key[here] == key[here + d]]
        yes = near(here, here + d)
        found.append((here[yes], here[yes] + d))
        here = here[~yes] if once else here
    return tuple(np.concatenate(x) for x in zip(*found))


def posted(nodes: DataFrame) -> DataFrame:
    """nodes(f, bits, wide): rows of lists dealt to buckets, with their keys, nodes and fingerprints laid end to end."""
    of = buckets(nodes.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, POSTED) for whole in batches for a in range(0, whole.num_rows, POSTED)):
            f = np.stack((np.asarray(batch.column("f")), np.asarray(batch.column("bits"))), axis=1)
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint8).reshape(-1, WIDE).astype(np.uint32)
            key = (np.arange(len(TRIPLES), dtype=np.uint32) << 24) | (wide[:, TRIPLES[:, 0]] << 16) | (wide[:, TRIPLES[:, 1]] << 8) | wide[:, TRIPLES[:, 2]]
            key, own = key.reshape(-1), np.repeat(f, len(TRIPLES), axis=0)
            bucket = remixed(key.astype(np.uint64), 0) % np.uint64(of)
            by = np.argsort(bucket, kind="stable")
            used, at = np.unique(bucket[by], return_index=True)
            cuts = [by[a:b] for a, b in zip(at, np.append(at[1:], len(by)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([key[x].tobytes() for x in cuts], pa.binary()), pa.array([own[x].tobytes() for x in cuts], pa.binary())], names=["bucket", "keys", "nodes"]
            )

    return nodes.select("f", "bits", "wide").mapInArrow(given_back(post), "bucket int, keys binary, nodes binary")


def first_pairs(nodes: DataFrame) -> DataFrame:
    """nodes(f, bits, wide): rows (a, b) of pairs to verify, and rows (list, members) of lists with three or more members and such a pair."""

    def meet(group: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(group.column("keys").to_pylist()), "<u4")
        node, bits = np.frombuffer(b"".join(group.column("nodes").to_pylist()), "<i8").reshape(-1, 2).T
        order = np.lexsort((remixed(node.view(np.uint64) ^ key, 1), key))  # in each list an order of its own
        key, node, bits = key[order], node[order], bits[order]
        i, j = in_lists(key, lambda x, y: differing(bits[x], bits[y]) <= LOOSE, True)
        pairs = np.unique(np.stack((np.maximum(node[i], node[j]), np.minimum(node[i], node[j])), axis=1), axis=0)
        begin = np.unique(np.searchsorted(key, key[i]))
        end = np.searchsorted(key, key[begin], "right")
        begin, end = begin[end - begin > 2], end[end - begin > 2]
        members = [node[a:b].tobytes() for a, b in zip(begin, end)]
        gap = pa.nulls(len(begin), pa.int64())
        return pa.concat_tables([
            pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "list": pa.nulls(len(pairs), pa.int64()), "members": pa.nulls(len(pairs), pa.binary())}),
            pa.table({"a": gap, "b": gap, "list": key[begin].astype(np.int64), "members": pa.array(members, pa.binary())}),
        ])

    return posted(nodes).groupBy("bucket").applyInArrow(meet, "a long, b long, list long, members binary")


def other_pairs(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """lists(list, members), nodes(f, bits, wide, root): pairs (a, b) of a list that may be alike and have different roots."""
    of = buckets(nodes.sparkSession)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, members in zip(batch.column("list").to_pylist(), batch.column("members").to_pylist()):
                f = np.frombuffer(members, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), n)), pa.array(f)], names=["list", "f"])

    def meet(group: pa.Table) -> pa.Table:
        key, node, bits, root = (np.asarray(group.column(c)) for c in ("list", "f", "bits", "root"))
        wide = np.frombuffer(b"".join(group.column("wide").to_pylist()), "<u8").reshape(-1, WIDE // 8)
        order = np.lexsort((node, key))
        key, node, bits, root, wide = key[order], node[order], bits[order], root[order], wide[order]

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = (root[x] != root[y]) & (differing(bits[x], bits[y]) <= LOOSE)
            out[out] = np.bitwise_count(wide[x[out]] ^ wide[y[out]]).sum(axis=1, dtype=np.int64) <= CLOSE
            return out

        i, j = in_lists(key, near, False)
        pairs = np.unique(np.stack((np.maximum(node[i], node[j]), np.minimum(node[i], node[j])), axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = lists.mapInArrow(apart, "list long, f long").join(nodes.select("f", "bits", "wide", "root"), "f")
    mixed = rows.join(rows.groupBy("list").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x < _y").select("list"), "list")
    bucket = F.pmod(F.xxhash64("list"), F.lit(of)).cast("int").alias("bucket")
    return mixed.select(bucket, "list", "f", "bits", "wide", "root").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def alike_groups(marked: DataFrame, least: float) -> DataFrame:
    """marked: rows of profiled(), several of one f alike. (f, root): one value for each group of sets linked by likenesses of `least` or more."""
    sets = marked.select("f", "shingles")
    same = F.min(F.struct("bits", "wide", (F.length("shingles") > 0).alias("full"))).alias("_s")
    nodes = written(marked.groupBy("f").agg(same).select("f", "_s.*"))

    def joined(ids: DataFrame, pairs: DataFrame) -> DataFrame:
        """ids(f, root): with the roots that these pairs of roots lead to."""
        found = components(pairs).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        return written(ids.join(found, "root", "left").select("f", F.coalesce("_to", "root").alias("root")))

    firsts = written(nodes.groupBy("bits").agg(F.min("f").alias("_f")))
    stars = nodes.join(firsts, "bits").where("f <> _f").select(F.col("f").alias("a"), F.col("_f").alias("b"))
    of = lambda c: firsts.select(F.col("bits").alias(c), F.col("_f").alias(f"_{c}"))
    near = links(firsts.select(F.col("bits").alias("f"))).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    group = joined(nodes.select("f", F.col("f").alias("root")), alike(stars.unionByName(near), sets, least))
    heads = written(nodes.join(group.where("f = root").select("f"), "f", "left_semi").where("full"))
    met = written(first_pairs(heads))
    ids = joined(heads.select("f", F.col("f").alias("root")), alike(met.where("a IS NOT NULL").select("a", "b").distinct(), sets, least))
    others = alike(other_pairs(met.where("list IS NOT NULL").select("list", "members"), heads.join(ids, "f")), sets, least)
    side = lambda c: ids.select(F.col("f").alias(c), F.col("root").alias(f"_{c}"))
    ids = joined(ids, others.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    ids = ids.select(F.col("f").alias("root"), F.col("root").alias("_to"))
    return group.join(ids, "root", "left").select("f", F.coalesce("_to", "root").alias("root"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, one row of each group linked by likenesses of `least` or more: one with the smallest key (a null key only where it has no other).

    Rows are told apart by two 64-bit hashes of key and text; of rows that share both one stays.
    Columns stay as they are.
    """
    h, g = fresh(docs, "_h", "_g")
    hashes = {h: F.xxhash64(key, text), g: F.xxhash64(F.lit("second"), key, text)}
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), hashes[h].alias("h"), hashes[g].alias("g"))
    marked = written(profiled(marked, words))
    order = F.min(F.struct(F.col("k").isNull(), "k", "h", "g")).alias("first")
    chosen = marked.select("k", "h", "g", "f").join(alike_groups(marked, least), "f").groupBy("root").agg(order).select(F.col("first.h").alias(h), F.col("first.g").alias(g))
    return docs.withColumns(hashes).join(chosen, [h, g], "left_semi").dropDuplicates([h, g]).drop(h, g)
