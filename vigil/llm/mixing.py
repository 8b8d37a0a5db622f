"""Mixing sources to target weights by subset-sum budget fitting.

A text's size is its number of words (runs of other characters than space, tab, line feed, vertical
tab, form feed and carriage return; null: 0). Sources, in the order of their code points with null
last, have the weights given, repeating, and share a budget of `share` times all sizes. A target
stops at `most` times its source's size; what is over is shared by weight among the others until no
target is above: targets are min(most * size, level * weight) for one level, which sorted running
sums give.

A source is taken wholly as often as its target holds it; the rest of its target is a subset sum over
its documents, counted by exact size. First the same share of each size is taken; what that leaves
over is filled from large sizes down to about WIDE words, which bounded-knapsack dynamic programming
fits with the ITEMS smallest sizes still free. If that misses the best sum that can be (the budget,
lowered to a multiple of the sizes' common divisor), the programming takes over more: twice the words
and sizes, up to SPAN words. What misses it still has a best sum that few sizes or their divisors
decide, and is fitted by residues: the programming then runs over the remainders by one size that many
documents have, which is exact and holds as many numbers as that size, however many documents there
are. Where no size is that frequent, all documents go through the programming from an empty start. So
no bound decides over the result. Of each size, documents are selected by cells of a seeded hash and by
the hash within the last cell; cells keep large groups of one size apart. Reruns give the same rows.

Rows stay one to one. Documents of size 0 (null and empty texts) are never taken; a source without
words has target 0. Very long texts are one size more. Repeated rows (equal doc_id, equal text) are told
apart by no more than their order. An empty table gives an empty one. Columns of the caller that have
the names of new ones are replaced, others pass through.
"""

from __future__ import annotations

from itertools import islice
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Words that are kept for the dynamic programming at first.
WIDE = 1 << 14
#: Sizes (of the free ones, smallest first) that it uses at first.
ITEMS = 64
#: Words up to which it is widened.
SPAN = 1 << 20
#: Cells over which documents of one size are dealt.
CELLS = 256
SEED = 11


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def programmed(free: dict[int, int], budget: int) -> dict[int, int]:
    """Counts of the sizes in `free`, none above its own, with the greatest sum up to `budget`."""
    # Bit v of reached[k]: the first k sizes make the sum v. Lots of 1, 2, 4, ... stand for a count.
    reached, sizes = [1], sorted(free)
    for s in sizes:
        now, left, lot = reached[-1], min(free[s], budget // s), 1
        while left > 0:
            n = min(lot, left)
            now = (now | (now << (s * n))) & ((1 << (budget + 1)) - 1)
            left, lot = left - n, lot * 2
        reached.append(now)
    best, taken = reached[-1].bit_length() - 1, {}
    for k in range(len(sizes), 0, -1):
        while not reached[k - 1] >> best & 1:
            taken[sizes[k - 1]] = taken.get(sizes[k - 1], 0) + 1
            best -= sizes[k - 1]
    return taken


def least_by_residue(others: dict[int, int], a: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """For each remainder by a the least sum of the others that leaves it (-1 for none), and the lots that make it: (size, number, where it is used)."""
    far = np.iinfo(np.int64).max // 2
    least, lots = np.full(a, far, np.int64), []
    least[0] = 0
    for s, c in sorted(others.items()):
        left, lot = min(c, a // gcd(a, s) - 1), 1  # more of them go round in a circle
        while left > 0:
            n = min(lot, left)
            other = np.roll(least, s * n % a) + s * n
            use = other < least
            least = np.where(use, other, least)
            lots.append((s, n, use))
            left, lot = left - n, 2 * lot
    return np.where(least < far, least, -1), lots


def traced(r: int, a: int, lots: list[tuple[int, int, np.ndarray]]) -> dict[int, int]:
    """How many of each size make the least sum of remainder r."""
    taken: dict[int, int] = {}
    for s, n, use in reversed(lots):
        if use[r]:
            taken[s] = taken.get(s, 0) + n
            r = (r - s * n) % a
    return taken


def circle(sizes: list[int], a: int) -> list[int]:
    """A part of these sizes whose sum a divides; there is one among any a sizes, as two of their running sums leave the same."""
    at, total = {0: 0}, 0
    for n, s in enumerate(sizes, 1):
        total = (total + s) % a
        if total in at:
            return sizes[at[total] : n]
        at[total] = n
    return []


def by_residues(counts: dict[int, int], budget: int) -> dict[int, int] | None:
    """The same as fit(), by one size a with as many documents as the largest other size has words; None if there is none.

    With v to be reached and S the sum of the others, v - S is filled with a. So S has v's remainder and lies
    between v - a * counts[a] and v, a range at least as wide as any sum of a sizes. The least S of each remainder
    is programmed, the greatest is what the least leaves. From these, groups of sizes that a divides are added,
    or taken away, in proportion, until S is in range.
    """
    fine = [s for s in counts if counts[s] >= max((x for x in counts if x != s), default=0)]
    if not fine:
        return None
    a = min(fine)
    others = {s: c for s, c in counts.items() if s != a}
    least, lots = least_by_residue(others, a)
    total, filled = sum(s * c for s, c in others.items()), a * counts[a]
    share = budget / (total + filled)
    for v in range(budget, max(-1, budget - a), -1):
        low, lack = int(least[v % a]), int(least[(total - v) % a])
        if low < 0 or low > v or total - lack < v - filled:
            continue
        floor = max(0, v - filled)
        if low >= floor:  # from the least up: nothing has to be added
            taken, way, goal = traced(v % a, a, lots), 1, min(v, round(total * share))
        else:  # from the greatest down
            gone = traced((total - v) % a, a, lots)
            taken, way, goal = {s: c - gone.get(s, 0) for s, c in others.items()}, -1, max(floor, round(total * share))
        now = sum(s * n for s, n in taken.items())
        for s in sorted(others, reverse=True):
            unit = a // gcd(a, s)
            own = (others[s] - taken.get(s, 0) if way > 0 else taken.get(s, 0)) // unit
            n = min(own, max(0, way * (goal - now)) // (unit * s))
            taken[s] = taken.get(s, 0) + way * n * unit
            now += way * n * unit * s
        while now > v:
            some = circle(list(islice((s for s in sorted(others) for _ in range(taken.get(s, 0))), a)), a)
            if not some:  # fewer than a are left, and the least would have done
                raise RuntimeError("residues do not fit")
            for s in some:
                taken[s] -= 1
                now -= s
        return {s: n for s, n in {**taken, a: (v - now) // a}.items() if n}
    return None


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size to take, none above its count, so that sizes have the greatest sum up to `budget`.

    counts: documents by size, sizes over 0.
    """
    total = sum(s * c for s, c in counts.items())
    budget = max(0, min(budget, total))
    if not budget:
        return {}
    goal, wide, items = budget - budget % gcd(*counts), WIDE, ITEMS
    while True:
        everything = items >= len(counts) and wide >= total
        taken = {s: 0 if everything else c * budget // total for s, c in counts.items()}
        rest = budget - sum(s * n for s, n in taken.items())
        free = {s: counts[s] - taken[s] for s in counts if counts[s] > taken[s]}
        small = sorted(free)[:items]
        kept = min(wide, sum(s * free[s] for s in small) // 2)
        # Large sizes first, down to what is kept for the programming over the small ones.
        for s in sorted(free.keys() - set(small), reverse=True):
            n = min(free[s], max(0, rest - kept) // s)
            taken[s] += n
            rest -= n * s
        for s, n in programmed({s: free[s] for s in small}, rest).items():
            taken[s] += n
        if everything or sum(s * n for s, n in taken.items()) == goal:
            return {s: n for s, n in taken.items() if n}
        if wide >= SPAN and not everything and (exact := by_residues(counts, budget)) is not None:
            return exact
        wide, items = 2 * wide, 2 * items


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(source, source_size), one row a source: adds `target`. Its windows run over all sources, a table of their number."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rank = F.row_number().over(by_name) - 1
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(rank, F.lit(len(weights)))]
    all_rows = Window.partitionBy()
    s = sources.withColumns({"_w": weight, "_cap": F.col("source_size") * F.lit(float(most)), "_rank": rank})
    s = s.withColumns({"_ratio": F.col("_cap") / F.col("_w"), "_budget": F.sum("source_size").over(all_rows) * F.lit(float(share))})
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_ratio", "_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    s = s.withColumn("_level", level)
    # The level is the first that its own source does not exceed.
    s = s.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(all_rows))
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at._level") * F.col("_w")))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The documents with `size`, `source_size`, `target` (of their source) and `taken` (words of theirs in the mix, repeats counted)."""
    new = ["size", "source_size", "target", "taken"]
    given = docs.drop(*new).columns
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text)))
    sized = docs.select(
        *(F.col(f"`{c}`").alias(f"_c{n}") for n, c in enumerate(given)), F.col(source).alias("source"), words(F.col(text)).alias("size"), hashed.alias("_h")
    ).withColumn("cell", F.pmod(F.col("_h"), F.lit(CELLS)).cast("int"))
    # Documents by source, size and cell; all that follows up to the join are such counts.
    cells = written(sized.groupBy("source", "size", "cell").agg(F.count("*").alias("n")))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    aims = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).withColumnRenamed("source", "of")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(target // total) if total else 0
        counts = {int(s): int(n) for s, n in zip(rows["size"], rows["n"]) if s > 0}
        extra = fit(counts, round(target - whole * total))
        return rows.assign(whole=whole, extra=[extra.get(int(s), 0) for s in rows["size"]])

    # A source's rows are its different sizes, not its documents.
    joined = by_size.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = joined.groupBy("source").applyInPandas(fitted, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in joined.schema)}, whole bigint, extra bigint")
    plan = plan.select(F.col("source").alias("of"), F.col("size").alias("in_size"), "source_size", "target", "whole", "extra")
    in_order = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    quota = before.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("in_size"))).select(
        "of", "in_size", F.col("cell").alias("in_cell"), "source_size", "target", "whole", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota")
    )
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("in_size")) & (F.col("cell") == F.col("in_cell"))
    place = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("_h"))
    out = sized.join(quota, same).withColumn("place", place)
    taken = F.col("size") * (F.col("whole") + (F.col("place") <= F.col("quota")).cast("bigint"))
    return out.select(*(F.col(f"_c{n}").alias(c) for n, c in enumerate(given)), "size", "source_size", "target", taken.alias("taken"))


def digests(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def drawn(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, columns unchanged."""
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_d{n}") for n, c in enumerate(docs.columns)), *(F.col(c).alias(f"_{c}") for c in ("doc_id", "text", "source")))
    out = mix(plain, "_text", "_source", "_doc_id")
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    out = out.withColumn("_times", times).where("_times > 0").withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
    return out.select(*(F.col(f"_d{n}").alias(c) for n, c in enumerate(docs.columns)))
