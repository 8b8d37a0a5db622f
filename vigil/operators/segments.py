"""Scans along one key's rows in segments, so that no key has to fit in one task.

A window over a key puts its whole history in one task, and one province may have most of the rows. Here
rows are cut by key and segment (a stretch of the order: a month, a range of ids). Each segment's outcome is
taken first, by an aggregate that combines before its shuffle; a small window over segments, one row each, says what each begins
with; that is put before the segment's rows as a row of its own, and windows of one segment finish. The largest
task is one segment of one key; null keys are a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _begun(df: DataFrame, outcome: Column, merged: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, _seg, _v, _first): what each segment begins with, for those that something comes before."""
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "_seg").agg(outcome.alias("_v"))
    return ends.withColumn("_v", merged.over(before)).where("_v IS NOT NULL").select(*keys, "_seg", "_v", F.lit(True).alias("_first"))


def _finished(df: DataFrame, begun: DataFrame, result: Column, keys: Sequence[str], order: Sequence[str], name: str, until: int) -> DataFrame:
    w = Window.partitionBy(*keys, "_seg").orderBy(F.desc("_first"), *order).rowsBetween(Window.unboundedPreceding, until)
    both = df.withColumn("_first", F.lit(False)).unionByName(begun, allowMissingColumns=True)
    return both.withColumn(name, result.over(w)).where("NOT _first").drop("_v", "_seg", "_first")


def filled(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], segment: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the last `value` that is not null up to each row, or before it if not inclusive.

    segment: rises with the order (a month of the first order column). Rows without it come before all others.
    """
    df = df.withColumns({"_v": value, "_seg": segment})
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    begun = _begun(df, last, F.last("_v", ignorenulls=True), keys)
    return _finished(df, begun, F.last("_v", ignorenulls=True), keys, order, name, 0 if inclusive else -1)


def running_sum(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], segment: Column, name: str) -> DataFrame:
    """Adds the sum of `value` up to each row; null while there is none."""
    df = df.withColumns({"_v": value, "_seg": segment})
    return _finished(df, _begun(df, F.sum("_v"), F.sum("_v"), keys), F.sum("_v"), keys, order, name, 0)
