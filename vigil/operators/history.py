"""Keyed histories: upserts, provenance, carry-forward, snapshots and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by `order` (ascending)."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(history: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """History with the updates merged in: of each key the update wins, of several updates the last by `order`."""
    both = history.withColumn("_prio", F.lit(0)).unionByName(updates.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    return dedupe_last(both, keys, [F.col("_prio"), *(F.col(o) for o in order)]).drop("_prio")


def upsert_series(series: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert of cumulative rows: updates without a confirmed count are no rows; a missing recovered keeps the previous one."""
    fresh = updates.where(F.col("confirmed").isNotNull())
    old = series.select(*keys, F.col("recovered").alias("_recovered"))
    fresh = fresh.join(old, list(keys), "left").withColumn("recovered", F.coalesce("recovered", "_recovered")).drop("_recovered")
    return upsert(series, fresh, keys)


def upsert_with_provenance(prev: DataFrame, fresh: DataFrame, key: Sequence[str], automatic: str, source: str = "source") -> DataFrame:
    """Fresh rows, and of the earlier ones those whose source is not like `automatic`, for keys that fresh rows lack."""
    manual = prev.where(~F.coalesce(F.col(source), F.lit("")).like(automatic))
    return fresh.unionByName(manual.join(fresh.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def upsert_conflicts(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, values): keys with more than one value that is not null."""
    found = rows.groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return found.where(F.size("values") > 1)


def needs_parse(files: DataFrame, index: DataFrame, key: str = "sitrep") -> DataFrame:
    """Files not in the index, or there without a date, or without a count whose failure is not final."""
    known = index.select(key, F.lit(True).alias("_known"), F.col("reporting_date").alias("_date"), F.col("confirmed").alias("_count"), F.col("confirmed_extraction_failed").alias("_final"))
    df = files.join(known, key, "left")
    retry = F.col("_count").isNull() & ~F.coalesce("_final", F.lit(False))
    return df.where(F.col("_known").isNull() | F.col("_date").isNull() | retry).drop("_known", "_date", "_count", "_final")


def validity(observed: DataFrame, entity: Sequence[str], values: Sequence[str], keys: Sequence[str] = (), date: str = "d") -> DataFrame:
    """(keys, entity, values, valid_from, valid_until): from each observation to the next one's date, not included; null for the last.

    Of observations of one entity and date one stands. As many rows as observations, whatever the dates between.
    """
    following = F.lead(date).over(Window.partitionBy(*keys, *entity).orderBy(date))
    out = observed.select(*keys, *entity, *values, F.col(date).alias("valid_from"), following.alias("valid_until"))
    return out.where("valid_until IS NULL OR valid_until > valid_from")


def carry_forward(observed: DataFrame, reports: DataFrame, entity: Sequence[str], values: Sequence[str], keys: Sequence[str] = (), date: str = "d") -> DataFrame:
    """Each report with every entity seen on an earlier or the same date, with its latest values; `carried` where it was absent.

    reports(keys, date): dates that have a snapshot, an array of dates a key (as many as days at most). Each value
    is valid from its own date to the next observation of its entity, which is a slice of that array, expanded as
    the last step: work grows with observations, only the result with reports times entities.
    """
    listed = F.array_sort(F.collect_set(date)).alias("_dates")
    days = observed.select(*keys, date, F.lit(0).alias("_r")).unionByName(reports.select(*keys, date, F.lit(1).alias("_r"))).groupBy(*keys, date).agg(F.max("_r").alias("_r"))
    earlier = F.sum("_r").over(Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    df = observed.select(*keys, *entity, date, *values).join(days.select(*keys, date, (F.coalesce(earlier, F.lit(0)) + 1).cast("int").alias("_p")), [*keys, date])
    df = df.withColumn("_q", F.lead("_p").over(Window.partitionBy(*keys, *entity).orderBy(date)))
    if keys:
        df = df.join(reports.groupBy(*keys).agg(listed), list(keys))
    else:
        df = df.withColumn("_dates", reports.agg(listed).scalar())
    valid = F.slice("_dates", F.col("_p"), F.coalesce("_q", F.size("_dates") + 1) - F.col("_p"))
    return df.select(*keys, *entity, F.explode(valid).alias("_d"), *values, F.col(date).alias("_from")).select(*keys, *entity, F.col("_d").alias(date), *values, (F.col("_d") != F.col("_from")).alias("carried"))


def never_seen(history: DataFrame, entity: Sequence[str], keys: Sequence[str], date: str = "d") -> DataFrame:
    """(keys, entity, date) of first appearances after the first report."""
    first = history.groupBy(*keys, *entity).agg(F.min(date).alias(date))
    begun = history.groupBy(*keys).agg(F.min(date).alias("_begun"))
    return first.join(begun, list(keys)).where(F.col(date) > F.col("_begun")).drop("_begun")


def snapshot_delta(history: DataFrame, entity: Sequence[str], values: Sequence[str], keys: Sequence[str], date: str = "d") -> DataFrame:
    """Adds new_<value>: growth since the report before, not below 0; an entity absent there counts from 0."""
    reports = history.select(*keys, date).distinct()
    before = reports.withColumn("_before", F.lag(date).over(Window.partitionBy(*keys).orderBy(date)))
    old = history.select(*keys, *entity, F.col(date).alias("_before"), *(F.col(v).alias(f"_{v}") for v in values))
    df = history.join(before, [*keys, date]).join(old, [*keys, *entity, "_before"], "left")
    grown = {f"new_{v}": F.greatest(F.lit(0), F.col(v) - F.coalesce(f"_{v}", F.lit(0))) for v in values}
    return df.withColumns(grown).drop("_before", *(f"_{v}" for v in values))


def live_overlay(snapshot: DataFrame, live: DataFrame, entity: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Snapshot rows with the fields of live rows where there are such, else their own, else 0."""
    fresh = live.select(*entity, *(F.col(f).alias(f"_{f}") for f in fields))
    df = snapshot.join(fresh, list(entity), "left")
    own = {f: F.coalesce(f"_{f}", f if f in snapshot.columns else F.lit(0), F.lit(0)) for f in fields}
    return df.withColumns(own).drop(*(f"_{f}" for f in fields))


def complete_from_history(live: DataFrame, last: DataFrame, entity: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Live rows and those entities of the last snapshot that they lack, daily fields 0 and the rate computed anew."""
    missing = last.join(live.select(*entity), list(entity), "left_anti")
    rate = F.when(F.col("cases") > 0, F.round(100.0 * F.col("deaths") / F.col("cases"), 1)).otherwise(F.lit(0.0))
    return live.unionByName(missing.withColumns({"cfr": rate, **{z: F.lit(0).cast("bigint") for z in zero}}).select(live.columns))


def snapshot_at(history: DataFrame, at: Column, keys: Sequence[str], date: str = "d") -> DataFrame:
    """Rows of each key's last report not after `at`."""
    last = history.where(F.col(date) <= at).groupBy(*keys).agg(F.max(date).alias(date))
    return history.join(last, [*keys, date], "left_semi")


def bucket_sums(df: DataFrame, key: Sequence[str], value: str, buckets: int) -> DataFrame:
    """(_bucket, rows, sum): a checksum of the rows of each bucket of keys, whatever their order."""
    sums = F.count("*").alias("rows"), F.sum(F.xxhash64(*key, value, *(F.col(c).isNull() for c in (*key, value))).cast("decimal(20,0)")).alias("sum")
    return df.groupBy(_bucket(key, buckets).alias("_bucket")).agg(*sums)


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets))


def differing_buckets(old: DataFrame, new: DataFrame, key: Sequence[str], value: str, buckets: int = 4096) -> DataFrame:
    """(_bucket): those whose checksums differ; at most `buckets` rows. Sums may be kept with a version instead of the rows."""
    a, b = bucket_sums(old, key, value, buckets), bucket_sums(new, key, value, buckets)
    both = a.join(b.select("_bucket", F.col("rows").alias("_rows"), F.col("sum").alias("_sum")), "_bucket", "full")
    return both.where("NOT (rows <=> _rows AND sum <=> _sum)").select("_bucket")


def diff_versions(old: DataFrame, new: DataFrame, key: Sequence[str], value: str, buckets: int = 4096) -> DataFrame:
    """(key, change, old_value, new_value): added, changed or removed keys.

    Checksums of buckets of keys are compared first, and only rows of buckets that differ are shuffled and
    joined: two versions that are nearly equal cost two scans. Rows of an equal bucket differ with a chance of 2^-64.
    """
    differ = F.broadcast(differing_buckets(old, new, key, value, buckets))  # `buckets` rows at most
    of = lambda df: df.withColumn("_bucket", _bucket(key, buckets)).join(differ, "_bucket", "left_semi")
    a = of(old).select(*key, F.col(value).alias("old_value"), F.lit(True).alias("_old"))
    b = of(new).select(*key, F.col(value).alias("new_value"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return a.join(b, list(key), "full").withColumn("change", change).where("change IS NOT NULL").drop("_old", "_new")


def recompute_from(history: DataFrame, changed: DataFrame, entity: Sequence[str], values: Sequence[str], date: str = "d") -> DataFrame:
    """Carry-forward of the dates from the earliest changed one on, whatever the order of arrival; no change gives no rows.

    Of the dates before, only each entity's last values are taken, and carried as if they were of the day before the change.
    """
    begin = changed.agg(F.min(date)).first()[0]  # one date
    if begin is None:
        return carry_forward(history.limit(0), history.limit(0), entity, values, (), date)
    later, eve = history.where(F.col(date) >= F.lit(begin)), F.date_sub(F.lit(begin), 1)
    held = history.where(F.col(date) < F.lit(begin)).groupBy(*entity).agg(F.max_by(F.struct(*values), date).alias("_v"))
    observed = later.select(*entity, date, *values).unionByName(held.select(*entity, eve.alias(date), "_v.*"))
    reports = later.select(date).unionByName(history.select(eve.alias(date)).limit(1))
    return carry_forward(observed, reports, entity, values, (), date).where(F.col(date) >= F.lit(begin))
