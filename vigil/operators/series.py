"""Operators over cumulative and daily series; `keys` partition every window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.segments import filled


def _ordered(keys: Sequence[str], date: str) -> Window:
    return Window.partitionBy(*keys).orderBy(date)


def increments(series: DataFrame, field: str, keys: Sequence[str], date: str = "d", out: str = "increment", segment: Column | None = None) -> DataFrame:
    """Difference from the previous value that is not null, never below 0; null for the first and for nulls.

    segment: cuts keys with very many rows by date (a month, say), each segment in a task of its own.
    """
    grown = lambda before: F.when(before.isNotNull() & F.col(field).isNotNull(), F.greatest(F.lit(0), F.col(field) - before))
    if segment is not None:
        return filled(series, F.col(field), keys, [date], segment, "_before", inclusive=False).withColumn(out, grown(F.col("_before"))).drop("_before")
    before = F.last(field, ignorenulls=True).over(_ordered(keys, date).rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumn(out, grown(before))


def split_catchup(incr: DataFrame, overrides: DataFrame, on: Sequence[str], increment: str = "increment", override: str = "override") -> DataFrame:
    """Adds `reported` and `catchup`: an override bounds what was reported, the rest of the increment is catch-up.

    overrides: one row for each of `on`; a small table of corrections, read beside each row.
    """
    df = incr.join(overrides, list(on), "left")
    reported = F.when(F.col(override).isNotNull() & F.col(increment).isNotNull(), F.least(override, increment)).otherwise(F.col(increment))
    catchup = F.when(F.col(override).isNotNull() & F.col(increment).isNotNull(), F.greatest(F.lit(0), F.col(increment) - F.col(override)))
    return df.withColumns({"reported": reported, "catchup": F.coalesce(catchup, F.lit(0))}).drop(override)


def cfr(deaths: Column, cases: Column, on_zero: float | None = None) -> Column:
    """Fatality in per cent, one decimal; `on_zero` where there are no cases."""
    return F.when(cases > 0, F.round(100.0 * deaths / cases, 1)).otherwise(F.lit(on_zero).cast("double"))


def last_known(series: DataFrame, fields: Sequence[str], keys: Sequence[str], date: str = "d") -> DataFrame:
    """One row a key: for each field its last value that is not null, that value's date and the value known before it."""
    earlier = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    df = series.withColumns({f"_{f}": F.last(f, ignorenulls=True).over(earlier) for f in fields})
    aggs = []
    for f in fields:
        top = F.max_by(F.struct(date, f, f"_{f}"), F.when(F.col(f).isNotNull(), F.col(date)))
        aggs += [top[f].alias(f"last_{f}"), top[date].alias(f"last_{f}_date"), top[f"_{f}"].alias(f"previous_{f}")]
    return df.groupBy(*keys).agg(*aggs)


def kpi_delta(last: DataFrame, field: str) -> DataFrame:
    """Adds delta_<field>: last known less the one before, not below 0."""
    delta = F.col(f"last_{field}") - F.col(f"previous_{field}")
    return last.withColumn(f"delta_{field}", F.when(delta.isNotNull(), F.greatest(F.lit(0), delta)))


def densify(series: DataFrame, keys: Sequence[str], date: str = "d") -> DataFrame:
    """Every day from the first to the last of each key; null where a day is absent. One row a key and day is expected."""
    ends = series.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date))
    return days.join(series, [*keys, date], "left")


def bridge_gaps(dense: DataFrame, field: str, keys: Sequence[str], date: str = "d", low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Adds `bridged` (gaps between known days filled on a straight line, within low..high) and `illustrative`."""
    w = _ordered(keys, date)
    known = F.when(F.col(field).isNotNull(), F.struct(F.col(date).alias("d"), F.col(field).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = dense.withColumns({"_a": a, "_b": b})
    share = F.datediff(date, "_a.d") / F.datediff("_b.d", "_a.d")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    line = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), line)))
    gap = F.col(field).isNull()
    return df.withColumns({"bridged": F.when(gap, line).otherwise(F.col(field)), "illustrative": gap & line.isNotNull()}).drop("_a", "_b")


def weekly_deltas(daily: DataFrame, fields: Sequence[str], keys: Sequence[str], date: str = "d") -> DataFrame:
    """Sums by week from Monday, with the days reported; null counts as 0."""
    sums = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields]
    return daily.groupBy(*keys, F.date_trunc("week", date).cast("date").alias("week")).agg(*sums, F.count("*").alias("days_reported"))


def weekly_share(weekly: DataFrame, fields: Sequence[str], prefix: DataFrame | None = None) -> DataFrame:
    """Adds <field>_share: per cent of the fields' sum, one decimal, 0 without any; published weeks go before."""
    total = sum((F.col(f) for f in fields), F.lit(0))
    out = weekly.withColumns({f"{f}_share": F.when(total > 0, F.round(100.0 * F.col(f) / total, 1)).otherwise(F.lit(0.0)) for f in fields})
    return out if prefix is None else prefix.unionByName(out, allowMissingColumns=True)


def crossings(series: DataFrame, field: str, steps: Sequence[int], keys: Sequence[str], date: str = "d") -> DataFrame:
    """(keys, step, date): the first date on which the field reaches each step."""
    step = F.explode(F.array(*(F.lit(s).cast("bigint") for s in steps))).alias("step")
    return series.select(*keys, date, field, step).where(F.col(field) >= F.col("step")).groupBy(*keys, "step").agg(F.min(date).alias(date))


def arrivals(history: DataFrame, entity: str, field: str, keys: Sequence[str], date: str = "d") -> DataFrame:
    """(keys, entity, date): first date above 0 of each entity but the first one; nothing where fewer than two have any."""
    first = history.where(F.col(field) > 0).groupBy(*keys, entity).agg(F.min(date).alias(date))
    w = Window.partitionBy(*keys)
    placed = first.withColumns({"_n": F.row_number().over(w.orderBy(date, entity)), "_of": F.count("*").over(w)})
    return placed.where("_n > 1 AND _of >= 2").drop("_n", "_of")


def case_window(history: DataFrame, field: str, keys: Sequence[str], date: str = "d") -> DataFrame:
    """(keys, first_case, last_case): first date above 0 and last date of a rise over the row before (0 before the first)."""
    rise = F.col(field) > F.lag(field, 1, 0).over(_ordered(keys, date))
    df = history.where(F.col(field).isNotNull()).withColumn("_rise", rise)
    first, last = F.min(F.when(F.col(field) > 0, F.col(date))), F.max(F.when(F.col("_rise"), F.col(date)))
    return df.groupBy(*keys).agg(first.alias("first_case"), last.alias("last_case")).where("first_case IS NOT NULL")


def rank_entities(df: DataFrame, entity: str, field: str, keys: Sequence[str]) -> DataFrame:
    """Adds `rank` by the field, descending, equal ones by name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(field).desc_nulls_last(), entity)))


def status_replay(history: DataFrame, field: str, keys: Sequence[str], date: str = "d", inactive_after: int | None = None) -> DataFrame:
    """Adds `days_no_case` (days since the cumulative last rose) and `status`: active, quiet, or inactive from `inactive_after` days on."""
    w = _ordered(keys, date)
    rise = F.col(field) > F.coalesce(F.lag(field).over(w), F.lit(0))
    since = F.last(F.when(rise, F.col(date)), ignorenulls=True)
    df = history.withColumn("_rise", rise).withColumn("_last", F.last(F.when(F.col("_rise"), F.col(date)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = F.datediff(date, "_last")
    status = F.when(days == 0, "active").when(F.lit(inactive_after is not None) & (days >= F.lit(inactive_after or 0)), "inactive").otherwise("quiet")
    return df.withColumns({"days_no_case": days, "status": status}).drop("_rise", "_last")


def advance_status(prev: DataFrame, today: DataFrame, key: str) -> DataFrame:
    """(key, status, days_no_case): today's rows with the next state. New cases: active (an epicentre stays one), no counter.

    None: the state stays and a counter that exists grows by one; an unknown key begins active.
    """
    df = today.join(prev.select(key, "status", "days_no_case"), key, "left")
    fresh = F.coalesce(F.col("new_cases"), F.lit(0)) > 0
    status = F.when(fresh & (F.col("status") == "epicentre"), "epicentre").when(fresh | F.col("status").isNull(), "active").otherwise(F.col("status"))
    return df.select(key, status.alias("status"), F.when(~fresh, F.col("days_no_case") + 1).alias("days_no_case"))


def effective_headline(primary: DataFrame, side: DataFrame, keys: Sequence[str], date: str = "d", require_values: Sequence[str] = ()) -> DataFrame:
    """The row of the later date, of equal dates the primary's; side rows without any of `require_values` do not count."""
    if require_values:
        side = side.where(F.coalesce(*require_values).isNotNull())
    both = primary.withColumn("is_primary", F.lit(True)).unionByName(side.withColumn("is_primary", F.lit(False)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in keys]
    top = both.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(date, "is_primary")).alias("_t"))
    return top.select(*keys, "_t.*")


def append_if_newer(series: DataFrame, side: DataFrame, keys: Sequence[str], date: str = "d") -> DataFrame:
    """The series and those side rows that are later than its last date; keys without a series take none."""
    last = series.groupBy(*keys).agg(F.max(date).alias("_last"))
    newer = side.join(last, list(keys)).where(F.col(date) > F.col("_last")).drop("_last")
    return series.unionByName(newer, allowMissingColumns=True)


def series_by_entity(history: DataFrame, entity: str, field: str, names: Sequence[str], keys: Sequence[str], date: str = "d") -> DataFrame:
    """One column a name over all dates; null where absent."""
    return history.groupBy(*keys, date).pivot(entity, list(names)).agg(F.first(field))


def toll_share(events: DataFrame, toll: str, keys: Sequence[str], out: str = "share") -> DataFrame:
    """Adds the toll in per cent of its peak, one decimal, at most 100."""
    peak = F.max(toll).over(Window.partitionBy(*keys))
    return events.withColumn(out, F.when(peak > 0, F.least(F.lit(100.0), F.round(100.0 * F.col(toll) / peak, 1))))


def series_range(series: DataFrame, keys: Sequence[str], date: str = "d") -> DataFrame:
    return series.groupBy(*keys).agg(F.count("*").alias("reports"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
