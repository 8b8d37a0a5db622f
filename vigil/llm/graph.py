"""Connected components over links of any number, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import checkpointed

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): values of one type that has an order (longs, bytes), not null. Returns (node, root), root the smallest node reachable; for nodes with links only.

    Loops and repeated edges are allowed; no edges give no rows. Each round hangs neighbours on the
    smallest node near them; rounds end when the set of edges no longer changes.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    now = checkpointed(ordered(edges))
    seen = state(now)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ordered(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(ordered(small.unionByName(low.select("a", F.col("m").alias("b")))))
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components not settled after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
