"""The quality gate: one row a check (check_id, scope, expected, actual, ok, blocking), and archive diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(df: DataFrame, scope: Column, checks: Sequence[tuple[str, Column, Column, Column, bool]]) -> DataFrame:
    """Long form of checks (id, expected, actual, ok, blocking) of each row."""
    made = [
        F.struct(F.lit(i).alias("check_id"), scope.cast("string").alias("scope"), e.cast("double").alias("expected"), a.cast("double").alias("actual"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(b).alias("blocking"))
        for i, e, a, ok, b in checks
    ]
    return df.select(F.inline(F.array(*made)))


def check_rollup(provinces: DataFrame, national: DataFrame, fields: Sequence[str], key: str, null_as_0: Sequence[str] = ()) -> DataFrame:
    """Sums of provinces equal the national values, by field."""
    zero = lambda c, f: F.coalesce(c, F.lit(0)) if f in null_as_0 else c
    sums = provinces.groupBy(key).agg(*(F.sum(f).alias(f"_{f}") for f in fields))
    df = national.join(sums, key)
    return _rows(df, F.col(key), [(f"rollup_{f}", zero(F.col(f), f), zero(F.col(f"_{f}"), f), zero(F.col(f), f) == zero(F.col(f"_{f}"), f), True) for f in fields])


def check_death_split(df: DataFrame, key: str, a: str, b: str, total: str) -> DataFrame:
    return _rows(df, F.col(key), [("death_split", F.col(total), F.col(a) + F.col(b), F.col(a) + F.col(b) == F.col(total), True)])


def check_rates(df: DataFrame, scope: Column, tolerance: float, check_id: str = "rate") -> DataFrame:
    """The printed rate is within the tolerance of the computed one (a hair more, for binary fractions)."""
    own = F.round(100.0 * F.col("deaths") / F.when(F.col("cases") > 0, F.col("cases")), 1)
    return _rows(df, scope, [(check_id, own, F.col("cfr"), F.abs(own - F.col("cfr")) <= tolerance + 1e-9, True)])


def check_count(declared: DataFrame, detailed: DataFrame, key: str, field: str, check_id: str, blocking: bool) -> DataFrame:
    """The declared number equals the number of detail rows."""
    n = detailed.groupBy(key).agg(F.count("*").alias("_n"))
    df = declared.join(n, key, "left")
    return _rows(df, F.col(key), [(check_id, F.col(field), F.coalesce("_n", F.lit(0)), F.col(field) == F.coalesce("_n", F.lit(0)), blocking)])


def check_sums(detail: DataFrame, totals: DataFrame, keys: Sequence[str], field: str, total: str, check_id: str, blocking: bool) -> DataFrame:
    """Sums of detail equal the totals, of keys that have detail."""
    s = detail.groupBy(*keys).agg(F.sum(field).alias("_s"))
    df = totals.join(s, list(keys))
    return _rows(df, F.concat_ws("/", *keys), [(check_id, F.col(total), F.col("_s"), F.col(total) == F.col("_s"), blocking)])


def check_none(df: DataFrame, bad: Column, check_id: str, name: str, keys: Sequence[str] = (), blocking: bool = True) -> DataFrame:
    """No row is `bad`; `offenders` has the first five by name."""
    w = Window.partitionBy(*keys).orderBy(name)
    first = df.where(bad).withColumn("_n", F.row_number().over(w)).where("_n <= 5").groupBy(*keys).agg(F.concat_ws(", ", F.array_sort(F.collect_list(name))).alias("offenders"))
    n = df.groupBy(*keys).agg(F.count(F.when(bad, 1)).alias("_bad"))
    n = n.join(first, list(keys), "left") if keys else n.crossJoin(first)
    out = n.select(F.lit(check_id).alias("check_id"), F.concat_ws("/", *keys).alias("scope"), F.lit(0.0).alias("expected"), F.col("_bad").cast("double").alias("actual"), (F.col("_bad") == 0).alias("ok"), F.lit(blocking).alias("blocking"), F.coalesce("offenders", F.lit("")).alias("offenders"))
    return out


def check_last_point(series: DataFrame, snapshot: DataFrame, key: str, fields: Sequence[str], date: str = "d") -> DataFrame:
    """The series' last date and its values are the snapshot's."""
    last = series.groupBy(key).agg(F.max(date).alias("_d"), *(F.max_by(f, date).alias(f"_{f}") for f in fields))
    df = snapshot.join(last, key)
    same = [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields]
    day = lambda c: F.unix_date(c)
    whole = same[0]
    for s in same[1:]:
        whole = whole & s
    return _rows(df, F.col(key), [("last_date", day(F.col(date)), day(F.col("_d")), F.col(date) == F.col("_d"), True), ("last_totals", F.col(fields[0]), F.col(f"_{fields[0]}"), whole, True)])


def check_unique_dates(series: DataFrame, keys: Sequence[str], date: str = "d") -> DataFrame:
    df = series.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(date).alias("_u"))
    return _rows(df, F.concat_ws("/", *keys), [("unique_dates", F.col("_n"), F.col("_u"), F.col("_n") == F.col("_u"), True)])


def check_monotone(series: DataFrame, field: str, keys: Sequence[str], date: str = "d") -> DataFrame:
    """Drops of a cumulative, null as 0; `offenders` has the first three dates."""
    w = Window.partitionBy(*keys).orderBy(date)
    v = F.coalesce(field, F.lit(0))
    df = series.withColumn("_drop", F.coalesce(v < F.lag(v).over(w), F.lit(False))).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_drop").orderBy(date)))
    three = F.collect_list(F.when(F.col("_drop") & (F.col("_n") <= 3), F.col(date).cast("string")))
    out = df.groupBy(*keys).agg(F.count(F.when(F.col("_drop"), 1)).alias("_bad"), F.concat_ws(", ", F.array_sort(three)).alias("offenders"))
    return out.select(F.lit("monotone").alias("check_id"), F.concat_ws("/", *keys).alias("scope"), F.lit(0.0).alias("expected"), F.col("_bad").cast("double").alias("actual"), (F.col("_bad") == 0).alias("ok"), F.lit(False).alias("blocking"), "offenders")


def check_covers(history: DataFrame, dates: DataFrame, date: str = "d") -> DataFrame:
    """Each date has rows in the history."""
    have = history.select(date).distinct().withColumn("_have", F.lit(1))
    df = dates.select(date).distinct().join(have, date, "left")
    return _rows(df, F.col(date), [("history_covers", F.lit(1), F.coalesce("_have", F.lit(0)), F.col("_have").isNotNull(), True)])


def check_reports(reports: DataFrame, files: DataFrame, current: str, key: str = "sitrep") -> DataFrame:
    """The current report is listed, ids are unique, listed files exist."""
    listed = reports.agg(F.count("*").alias("n"), F.count_distinct(key).alias("u"), F.count(F.when(F.col(key) == current, 1)).alias("c"))
    lost = reports.join(files.select("file").distinct(), "file", "left_anti").agg(F.count("*").alias("lost"))
    df = listed.crossJoin(lost)  # one row each
    return _rows(df, F.lit("reports"), [("current_listed", F.lit(1), F.col("c"), F.col("c") > 0, True), ("ids_unique", F.col("n"), F.col("u"), F.col("n") == F.col("u"), True), ("files_exist", F.lit(0), F.col("lost"), F.col("lost") == 0, True)])


def gate(zones: DataFrame, provinces: DataFrame, national: DataFrame, key: str, fields: Sequence[str] = ("cases", "deaths"), tolerance: tuple[float, float] = (0.1, 0.15)) -> DataFrame:
    """All checks between the levels, in one pass: each input is read once and one roll-up makes the levels.

    zones(key, province, zone, fields); provinces(key, province, fields, cfr, zones: declared); national(key, fields, cfr,
    zones). The rows of all three are put in one table, each level's values in columns of its own, and
    summed by (key, province, zone), (key, province) and (key). Of a level both its own published values and
    the sums of the finer ones are then in one row. Nation: provinces' sums, declared zones, detailed
    zones (not blocking), rate. Province: zones' sums where there is detail (not blocking), rate. Zones: those below zero
    or with more deaths than cases, as rows that are not ok; a zone that is fine has none. Nulls count as 0; without cases there is no rate to check.
    """
    lead = lambda p, names: [F.col(n).alias(f"{p}_{n}") for n in names]
    told = (*fields, "cfr", "zones")
    z = zones.select(key, "province", "zone", *lead("z", fields), F.lit(1).alias("z_n"))
    p = provinces.select(key, "province", *lead("p", told), F.lit(1).alias("p_n"))
    n = national.select(key, *lead("n", told), F.lit(1).alias("n_n"))
    rows = z.unionByName(p, allowMissingColumns=True).unionByName(n, allowMissingColumns=True)
    measures = [c for c in rows.columns if c not in (key, "province", "zone")]
    sets = [[F.col(key), F.col("province"), F.col("zone")], [F.col(key), F.col("province")], [F.col(key)]]
    sums = rows.groupingSets(sets, F.col(key), F.col("province"), F.col("zone")).agg(F.grouping_id().alias("_level"), *(F.sum(c).alias(c) for c in measures))

    zero = lambda c: F.coalesce(c, F.lit(0))

    def equal(name: str, a: str, b: str, blocking: bool) -> tuple[str, Column, Column, Column, bool]:
        return name, zero(a), zero(b), zero(a) == zero(b), blocking

    def rate(prefix: str, slack: float) -> tuple[str, Column, Column, Column, bool]:
        own, cfr = F.round(100.0 * zero(f"{prefix}_{fields[1]}") / cases(prefix), 1), zero(f"{prefix}_cfr")
        return "rate", own, cfr, F.abs(own - cfr) <= slack + 1e-9, True

    def cases(prefix: str) -> Column:
        return F.when(F.col(f"{prefix}_{fields[0]}") > 0, F.col(f"{prefix}_{fields[0]}"))

    def level(of: int, there: Column, scope: Column, checks: Sequence[tuple[str, Column, Column, Column, bool]]) -> Column:
        made = [F.struct(F.lit(i).alias("check_id"), scope.cast("string").alias("scope"), e.cast("double").alias("expected"), a.cast("double").alias("actual"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(b).alias("blocking")) for i, e, a, ok, b in checks]
        return F.when((F.col("_level") == of) & (there > 0), F.array(*made))

    nation = [equal(f"rollup_{f}", f"n_{f}", f"p_{f}", True) for f in fields]
    nation += [equal("declared_zones", "n_zones", "p_zones", True), equal("zone_count", "p_zones", "z_n", False)]
    low, some, dead = zero(F.least(*(f"z_{f}" for f in fields))), zero(f"z_{fields[0]}"), zero(f"z_{fields[1]}")
    zone = [("non_negative", F.lit(0), low, low >= 0, True), ("deaths_le_cases", some, dead, dead <= some, True)]
    at = F.concat_ws("/", key, "province")
    levels = [
        level(3, F.col("n_n"), F.col(key), nation), level(3, cases("n"), F.col(key), [rate("n", tolerance[0])]),
        level(1, F.when(F.col("p_n") > 0, F.col("z_n")), at, [equal("zone_sums", f"p_{fields[0]}", f"z_{fields[0]}", False)]), level(1, cases("p"), at, [rate("p", tolerance[1])]),
        F.filter(level(0, F.col("z_n"), F.concat_ws("/", key, "province", "zone"), zone), lambda c: ~c["ok"]),
    ]
    return sums.select(F.inline(F.flatten(F.array_compact(F.array(*levels)))))


def verdict(checks: DataFrame) -> DataFrame:
    """(passed, blocking_failures, warnings) over all checks."""
    bad = ~F.col("ok")
    return checks.agg((F.count(F.when(bad & F.col("blocking"), 1)) == 0).alias("passed"), F.count(F.when(bad & F.col("blocking"), 1)).alias("blocking_failures"), F.count(F.when(bad & ~F.col("blocking"), 1)).alias("warnings"))


def stage_success(diag: DataFrame, stages: Sequence[str], number: str = "number", width: int = 10) -> DataFrame:
    """(stage, bucket, n, ok, failed): outcomes of each stage by block of report numbers, 1 to 10 first; failed lists numbers."""
    long = diag.select(number, F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("fine")) for s in stages))))
    bucket = (F.floor((F.col(number) - 1) / width) * width + 1).cast("bigint")
    lost = F.array_sort(F.collect_list(F.when(~F.col("fine"), F.col(number))))
    return long.groupBy("stage", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(F.col("fine"), 1)).alias("ok"), F.concat_ws(",", F.transform(lost, lambda x: x.cast("string"))).alias("failed"))


def outcome_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), category)


def shared_ids(reports: DataFrame, key: str, date: str = "d") -> DataFrame:
    """(key, dates): ids that stand at more than one date."""
    return reports.groupBy(key).agg(F.array_sort(F.collect_set(date)).alias("dates")).where(F.size("dates") > 1)


def expected_range(index: DataFrame, number: str, lo: int, hi: int) -> DataFrame:
    """(number, present) for each number of the range."""
    have = index.select(F.col(number).cast("bigint").alias("number")).distinct().withColumn("present", F.lit(True))
    return index.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "number").join(have, "number", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def explain_missing(calendar: DataFrame, history: DataFrame, reports: DataFrame, date: str = "d") -> DataFrame:
    """(date, why): days that the history lacks: 'no report', 'no section' or 'recoverable'. reports(date, has_section)."""
    r = reports.groupBy(date).agg(F.max(F.col("has_section").cast("int")).alias("_s"))
    missing = calendar.select(date).distinct().join(history.select(date), date, "left_anti").join(r, date, "left")
    return missing.select(date, F.when(F.col("_s").isNull(), "no report").when(F.col("_s") == 0, "no section").otherwise("recoverable").alias("why"))
