"""Order MinHash fingerprints, by DataFrame functions alone.

Tokens are pieces of up to 8 characters of each word (words are runs of other characters than space,
tab, line feed, vertical tab, form feed and carriage return). Each k-mer of tokens is numbered by its
occurrence in the text, so that repeats count. For each of `size` orders of all numbered k-mers the
`tuple_size` least are selected, put back into their order in the text and hashed together: two texts
share a component if they share these k-mers in the same order, which falls with the edit distance.

Numbered k-mers have 64-bit hashes, and the hash range is cut into `size` cells. Order j begins with
cell j and goes on through the others as a hash seeded by j puts them; within a cell it goes by the
hash. So each order has a start of its own, and where a cell is empty, as most are in short texts,
the next ones come in an order of its own, too. Each order is one of all numbered k-mers, the same for
every text. Components are 1 to 65535; a text without tokens has zeros only. Fewer tokens than k make
one k-mer, fewer k-mers than a tuple holds a shorter tuple; null is as empty.

Repeated rows have equal fingerprints; an empty table gives an empty one. Very long texts are read
whole, in arrays of a few values a token. A column of the caller that has the name of the new one is
replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import fresh

TOKEN = r"[^\x20\x09-\x0D]{1,8}"
RANGES = 256
#: Documents that one group of neighbours holds, about.
GROUP = 20_000
#: Groups up to which their first ids (a row of 16 bytes each) are sent to all tasks.
SENT = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def signature(text: Column, size: int = 64, k: int = 3, tuple_size: int = 2) -> Column:
    """array<int> of `size` components."""

    def kmers(h: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(h[i + n] for n in range(k))))
        return F.when(F.size(h) >= k, whole).otherwise(F.array(F.xxhash64(h)))

    def numbered(s: Column) -> Column:
        """s: sorted (hash of k-mer, place). First occurrences keep their hash; n-th ones, n from 1, hash it with n."""
        new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda p: (p == 0) | (s[p]["g"] != s[F.greatest(p - 1, F.lit(0))]["g"]))

        def later(starts: Column) -> Column:
            after = lambda n: F.coalesce(F.get(starts, n + 1), F.size(s))
            runs = F.transform(starts, lambda p, n: F.when(after(n) - p > 1, F.struct(p.alias("p"), (after(n) - p).alias("n"))))
            runs = F.filter(runs, lambda r: r.isNotNull())
            one = lambda r: F.transform(
                F.slice(s, r["p"] + 2, r["n"] - 1), lambda e, n: F.struct(F.xxhash64(e["g"], n + 1).alias("g"), e["i"].alias("i"))
            )
            return F.concat(F.transform(starts, lambda p: s[p]), F.flatten(F.transform(runs, one)))

        return let(new, lambda starts: F.when(F.size(starts) == F.size(s), s).otherwise(later(starts)))

    cells = F.sequence(F.lit(0), F.lit(size - 1))

    def components(g: Column) -> Column:
        marks = F.transform(cells, lambda j: F.struct(((j - F.lit(size // 2)).cast("bigint") * F.lit((1 << 64) // size)).alias("g"), F.lit(-1).alias("i")))

        def pick(s: Column) -> Column:
            at = F.filter(F.transform(s, lambda e, p: F.when(e["i"] < 0, p)), lambda p: p.isNotNull())
            starts = F.concat(F.transform(at, lambda p, j: p - j), F.array(F.size(s) - size))
            return let(F.filter(s, lambda e: e["i"] >= 0), lambda own: let(starts, lambda begin: each(own, begin)))

        def each(own: Column, begin: Column) -> Column:
            """own: sorted; begin: where each cell begins in it, and the end."""
            full = F.filter(cells, lambda c: begin[c + 1] > begin[c])

            def tuple_of(least: Column) -> Column:
                in_text = F.sort_array(F.transform(least, lambda e: F.struct(e["i"].alias("i"), e["g"].alias("g"))))
                return hashed(F.xxhash64(F.transform(in_text, lambda e: e["g"])))

            def hashed(h: Column) -> Column:
                return (F.pmod(h, F.lit(65535)) + 1).cast("int")

            def elsewhere(j: Column, full: Column) -> Column:
                """The least by order j: of its own cell, then of the next cells that hold any."""
                rank = lambda c: F.when(c == j, F.lit(-(1 << 63))).otherwise(F.xxhash64(j, c))
                by = F.sort_array(F.transform(full, lambda c: F.struct(rank(c).alias("r"), c.alias("c"))))
                some = F.transform(F.slice(by, 1, tuple_size), lambda x: F.slice(own, begin[x["c"]] + 1, F.least(begin[x["c"] + 1] - begin[x["c"]], F.lit(tuple_size))))
                return tuple_of(F.slice(F.flatten(some), 1, tuple_size))

            def within(j: Column) -> Column:
                if tuple_size != 2:
                    return tuple_of(F.slice(own, begin[j] + 1, tuple_size))
                a, b = own[begin[j]], own[begin[j] + 1]
                return hashed(F.when(a["i"] <= b["i"], F.xxhash64(F.array(a["g"], b["g"]))).otherwise(F.xxhash64(F.array(b["g"], a["g"]))))

            one = lambda full: F.transform(cells, lambda j: F.when(begin[j + 1] - begin[j] >= tuple_size, within(j)).otherwise(elsewhere(j, full)))
            return let(full, one)

        return let(F.sort_array(F.concat(g, marks)), pick)

    def whole(h: Column) -> Column:
        placed = lambda x: F.sort_array(F.transform(x, lambda e, i: F.struct(e.alias("g"), i.alias("i"))))
        return let(kmers(h), lambda x: let(placed(x), lambda s: let(numbered(s), components)))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return let(hashes, lambda h: F.when(F.size(h) > 0, whole(h)).otherwise(F.array_repeat(F.lit(0), size)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def as_text(components: Column) -> Column:
    return F.array_join(F.transform(components, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def with_next(rows: DataFrame, add: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """rows(doc_id, text): adds next_<c> for each of `carried`, from the row next in descending doc_id, after the last the first.

    Null ids come last, equal ids in the order of their texts. No task holds more than a group of
    neighbours: ids are cut at approximate quantiles, and evenly between these where there are many
    rows; into each group goes one more row, the first of the group that follows.
    add: computes columns of the rows and of these additions, before they are dealt out.
    """
    cuts = F.percentile_approx("doc_id", [n / RANGES for n in range(1, RANGES)], 10_000)
    at, low, high, n = rows.agg(cuts, F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    edges = [low or 0, *sorted(set(at or [])), high or 0]
    within = max(1, -(-n // (RANGES * GROUP)))
    inner = F.array(*(F.lit(x).cast("bigint") for x in edges[1:-1])) if edges[1:-1] else F.array().cast("array<bigint>")
    # Of a row: how many cuts lie below it, then its share of the stretch between the cuts around it.
    ends = F.array(*(F.lit(x).cast("bigint") for x in edges))
    group = F.size(F.filter(inner, lambda x: x < F.col("doc_id"))).cast("bigint")
    if within > 1:
        share = (F.col("doc_id") - ends[group.cast("int")]) / (ends[group.cast("int") + 1] - ends[group.cast("int")] + 1)
        group = group * within + F.least(F.lit(within - 1), F.greatest(F.lit(0), F.floor(share * within)))
    own, added, head, serves = fresh(rows, "_group", "_added", "_head", "_serves")
    rows = rows.withColumn(own, F.coalesce(F.when(F.col("doc_id").isNotNull(), group), F.lit(-1).cast("bigint")))
    heads = rows.groupBy(own).agg(F.max("doc_id").alias(head))  # a row for each GROUP rows
    above = F.coalesce(F.lead(own).over(Window.orderBy(own)), F.min(own).over(Window.partitionBy()))
    heads = heads.select(head, above.alias(serves))
    if RANGES * within <= SENT:
        heads = F.broadcast(heads)
    first = rows.join(heads, F.col("doc_id").eqNullSafe(F.col(head)))
    first = first.withColumn(own, F.col(serves)).drop(head, serves).withColumn(added, F.lit(1))
    all_rows = add(rows.withColumn(added, F.lit(0))).unionByName(add(first))
    w = Window.partitionBy(own).orderBy(added, F.col("doc_id").desc_nulls_last(), "text")
    nexts = {f"next_{c}": F.lead(c).over(w) for c in carried}
    return all_rows.withColumns(nexts).where(F.col(added) == 0).drop(own, added)


def fingerprints(docs: DataFrame, size: int = 64, k: int = 3, tuple_size: int = 2) -> DataFrame:
    """docs(doc_id, text, ...): adds `order_minhash`, an array<int> of components."""
    return docs.withColumn("order_minhash", signature(F.coalesce("text", F.lit("")), size, k, tuple_size))


def digests(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text and the likeness of both and of the next document's.

    The edited text ends in the beginning of the next document's text instead of its own last third.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(rows, lambda df: fingerprints(df), ["text", "order_minhash"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    near = near.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "order_minhash", "next_order_minhash")
    near = near.withColumn("edited_minhash", signature(F.col("edited")))
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("order_minhash")).alias("fingerprint"),
        as_text(F.col("edited_minhash")).alias("edited_fingerprint"),
        likeness(F.col("order_minhash"), F.col("edited_minhash")).alias("near_edited"),
        likeness(F.col("order_minhash"), F.col("next_order_minhash")).alias("near_next"),
    )
