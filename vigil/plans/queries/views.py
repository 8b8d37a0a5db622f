"""Queries of roll-ups, orders, timelines and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import quality as Q
from vigil.operators import series as S
from vigil.operators import views as V
from vigil.plans.registry import query


@query("a3_rollup_national", "SELECT d, CAST(SUM(new_cases) AS BIGINT) AS new_cases, CAST(SUM(new_deaths) AS BIGINT) AS new_deaths FROM fx_zone_day GROUP BY d")
def _(fx):
    return V.rollup_national(fx.zone_day, ["new_cases", "new_deaths"], ["d"])


@query("a4_national_scope", "SELECT COUNT(DISTINCT province || '/' || zone) AS zones, COUNT(DISTINCT province) AS provinces, MIN(d) AS first_report, COUNT(DISTINCT d) AS reports FROM fx_zone_day")
def _(fx):
    return V.national_scope(fx.zone_day, fx.zone_day)


TOTALS = "SELECT province, zone, CAST(SUM(new_cases) AS BIGINT) AS cases, CAST(SUM(new_deaths) AS BIGINT) AS deaths FROM fx_zone_day GROUP BY province, zone"


def totals(fx):
    return fx.zone_day.groupBy("province", "zone").agg(F.sum("new_cases").alias("cases"), F.sum("new_deaths").alias("deaths"))


@query("a6_share_of_total", """
WITH t AS (SELECT province, zone, d, new_cases, SUM(new_cases) OVER (PARTITION BY zone) AS s FROM fx_zone_day)
SELECT province, zone, d, ROUND(100.0E0 * new_cases / s, 6) AS share, CASE WHEN 100.0E0 * new_cases / s < 0.1 AND new_cases > 0 THEN '<0.1' ELSE printf('%.1f', ROUND(100.0E0 * new_cases / s, 1)) END AS label FROM t""")
def _(fx):
    return V.share_of_total(fx.zone_day, "new_cases", ["zone"]).select("province", "zone", "d", "share", "label")


@query("a7_reports_by_month", """
SELECT COALESCE(strftime(d, '%Y-%m'), 'unknown') AS month, COUNT(*) AS reports, string_agg(id, ',' ORDER BY id DESC) AS ids
FROM (SELECT CASE WHEN DAY(d) <> 30 THEN d END AS d, strftime(d, '%Y%m%d') AS id FROM fx_sitreps) t GROUP BY 1""")
def _(fx):
    r = fx.sitreps.select(F.when(F.dayofmonth("d") != 30, F.col("d")).alias("d"), F.date_format("d", "yyyyMMdd").alias("sitrep"))
    return V.reports_by_month(r).withColumn("ids", F.concat_ws(",", "ids"))


@query("a8_zones_by_province", """
WITH f AS (SELECT province, zone, MIN(d) AS first FROM fx_zone_day GROUP BY province, zone)
SELECT province, string_agg(zone, ',' ORDER BY first, zone) AS zones, MIN(first) AS first FROM f GROUP BY province""")
def _(fx):
    f = fx.zone_day.groupBy("province", "zone").agg(F.min("d").alias("first_day"))
    return V.zones_by_province(f, "first_day").withColumn("zones", F.concat_ws(",", "zones"))


@query("a12_relative_bar", f"""
SELECT province, zone, GREATEST(2, CAST(ROUND(100.0E0 * cases / MAX(cases) OVER (PARTITION BY province), 0) AS INT)) AS bar FROM ({TOTALS}) t""")
def _(fx):
    return V.relative_bar(totals(fx), "cases", ["province"]).select("province", "zone", "bar")


@query("x39_filter_zones", f"SELECT * FROM ({TOTALS}) t WHERE province = 'ASIA' AND lower(zone) LIKE '%na%'")
def _(fx):
    return V.filter_zones(totals(fx), "ASIA", "NA")


@query("x40_search_reports", "SELECT doc_id FROM documents WHERE lower(concat_ws(' ', source, lang)) LIKE '%src7 en%'")
def _(fx):
    docs = fx.table("documents").withColumn("d", F.lit("2026-01-01").cast("date"))
    return V.search_reports(docs, " SRC7 en ", "2025-01", ["source", "lang"]).select("doc_id")


@query("x33_exclude_reports", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def _(fx):
    return V.exclude_reports(fx.table("documents").select("doc_id", "source"), ["src1", "src2"], "source")


@query("k1_sort_zones", TOTALS)
def _(fx):
    return V.sort_zones(totals(fx), "zone")


@query("k2_by_confirmed", TOTALS)
def _(fx):
    return V.by_confirmed(totals(fx), "cases", "zone")


@query("k3_newest_first", "SELECT d, confirmed FROM fx_sitreps")
def _(fx):
    return V.newest_first(fx.sitreps.select("d", "confirmed"))


STEPS = [10, 100, 1000]
TIMELINE = f"""WITH x AS (SELECT CAST(step AS BIGINT) AS step, MIN(d) AS d FROM fx_sitreps, (SELECT UNNEST({STEPS}) AS step) s WHERE confirmed >= step GROUP BY step),
f AS (SELECT province, MIN(d) AS d FROM fx_province_history WHERE confirmed > 0 GROUP BY province), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY d, province) AS n FROM f),
t AS (SELECT MIN(d) AS d, 'first' AS kind, CAST(NULL AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS name FROM fx_sitreps UNION ALL SELECT MAX(d), 'current', NULL, NULL FROM fx_sitreps
UNION ALL SELECT d, 'crossing', step, NULL FROM x UNION ALL SELECT d, 'arrival', NULL, province FROM r WHERE n > 1)
"""


def events(fx):
    o = ["outbreak"]
    national = fx.sitreps.withColumn("outbreak", F.lit("o1"))
    history = fx.province_history.withColumn("outbreak", F.lit("o1"))
    return V.milestones(national, S.crossings(national, "confirmed", STEPS, o), S.arrivals(history, "province", "confirmed", o), o, "province").drop("outbreak")


@query("u1_timeline", TIMELINE + "SELECT * FROM t")
def _(fx):
    return events(fx)


@query("k4_timeline_head", TIMELINE + "SELECT * FROM t ORDER BY d, kind, name NULLS FIRST, step NULLS FIRST LIMIT 4")
def _(fx):
    return V.timeline_head(events(fx), 4, ["d", "kind", "name", "step"])


@query("k5_top_n_per", """
SELECT province, zone, d, new_cases, CAST(n AS INT) AS rank FROM (SELECT province, zone, d, new_cases, ROW_NUMBER() OVER (PARTITION BY province, zone ORDER BY new_cases DESC, d) AS n FROM fx_zone_day) t WHERE n <= 3""")
def _(fx):
    return V.top_n_per(fx.zone_day, ["province", "zone"], [F.col("new_cases").desc(), F.col("d")], 3).select("province", "zone", "d", "new_cases", "rank")


@query("k6_result_counts", "SELECT province, COUNT(*) FILTER (WHERE new_deaths > 0) AS shown, COUNT(*) AS total FROM fx_zone_day GROUP BY province")
def _(fx):
    return V.result_counts(fx.zone_day, F.col("new_deaths") > 0, ["province"])


@query("u3_stale_artifacts", "SELECT url AS path FROM pages WHERE page_id % 3 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def _(fx):
    p = fx.table("pages")
    return V.stale_artifacts(p.where("page_id % 3 = 0").select(F.col("url").alias("path")), p.where("page_id % 2 = 0").select(F.col("url").alias("path")))


@query("s2_with_defaults", """
WITH l AS (SELECT zone, cases FROM (SELECT zone, MAX(cases) AS cases FROM fx_zone_history GROUP BY zone) t WHERE cases % 2 = 0)
SELECT zone, cases, 'latest' AS origin FROM l UNION ALL SELECT n_name, CAST(0 AS BIGINT), 'seed' FROM nation WHERE n_name NOT IN (SELECT zone FROM l)""")
def _(fx):
    latest = fx.zone_history.groupBy("zone").agg(F.max("cases").alias("cases")).where("cases % 2 = 0").withColumn("origin", F.lit("latest"))
    seeds = fx.table("nation").select(F.col("n_name").alias("zone"), F.lit(0).cast("bigint").alias("cases"), F.lit("seed").alias("origin"))
    return V.with_defaults(latest, seeds, ["zone"])


ROLL = """WITH p AS (SELECT province, d, SUM(new_cases) AS c, SUM(new_deaths) AS dd FROM fx_zone_day GROUP BY province, d),
n AS (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS c, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + CASE WHEN DAY(o_orderdate) = 9 THEN 1 ELSE 0 END AS dd FROM orders GROUP BY CAST(o_orderdate AS DATE), DAY(o_orderdate))
"""


def national_day(fx):
    return fx.sql("SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS new_cases, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + CASE WHEN DAY(o_orderdate) = 9 THEN 1 ELSE 0 END AS new_deaths FROM orders GROUP BY CAST(o_orderdate AS DATE), DAY(o_orderdate)")


def rollup_check(fx):
    return Q.check_rollup(fx.zone_day.groupBy("province", "d").agg(F.sum("new_cases").alias("new_cases"), F.sum("new_deaths").alias("new_deaths")), national_day(fx), ["new_cases", "new_deaths"], "d")


Q1 = ROLL + """, s AS (SELECT d, SUM(c) AS c, SUM(dd) AS dd FROM p GROUP BY d),
q AS (SELECT 'rollup_new_cases' AS check_id, CAST(n.d AS VARCHAR) AS scope, CAST(n.c AS DOUBLE) AS expected, CAST(s.c AS DOUBLE) AS actual, n.c = s.c AS ok, TRUE AS blocking FROM n JOIN s ON n.d = s.d
UNION ALL SELECT 'rollup_new_deaths', CAST(n.d AS VARCHAR), CAST(n.dd AS DOUBLE), CAST(s.dd AS DOUBLE), n.dd = s.dd, TRUE FROM n JOIN s ON n.d = s.d)
"""


@query("q1_check_rollup", Q1 + "SELECT * FROM q")
def _(fx):
    return rollup_check(fx)


@query("q2_check_death_split", """
SELECT 'death_split' AS check_id, CAST(d AS VARCHAR) AS scope, CAST(t AS DOUBLE) AS expected, CAST(community + intra AS DOUBLE) AS actual, community + intra = t AS ok, TRUE AS blocking
FROM (SELECT d, community, intra, community + intra + CASE WHEN DAY(d) = 11 THEN 1 ELSE 0 END AS t FROM fx_community_daily) x""")
def _(fx):
    df = fx.community_daily.withColumn("total", F.col("community") + F.col("intra") + F.when(F.dayofmonth("d") == 11, 1).otherwise(0))
    return Q.check_death_split(df, "d", "community", "intra", "total")


@query("q3_check_rates", """
WITH t AS (SELECT zone || ' ' || CAST(d AS VARCHAR) AS scope, ROUND(100.0E0 * deaths / cases, 1) AS own, ROUND(100.0E0 * deaths / cases, 1) + CASE WHEN DAY(d) = 8 THEN 0.2E0 WHEN DAY(d) = 9 THEN 0.1E0 ELSE 0.0E0 END AS cfr FROM fx_zone_history WHERE cases > 0)
SELECT 'rate' AS check_id, scope, own AS expected, cfr AS actual, ABS(own - cfr) <= 0.15 + 1E-9 AS ok, TRUE AS blocking FROM t""")
def _(fx):
    own = F.round(100.0 * F.col("deaths") / F.col("cases"), 1)
    off = F.when(F.dayofmonth("d") == 8, 0.2).when(F.dayofmonth("d") == 9, 0.1).otherwise(0.0)
    df = fx.zone_history.withColumn("cfr", own + off)
    return Q.check_rates(df, F.concat_ws(" ", "zone", "d"), 0.15)


@query("q4_check_declared_zones", """
SELECT 'declared_zones' AS check_id, r_name AS scope, CAST(n AS DOUBLE) AS expected, CAST(s AS DOUBLE) AS actual, n = s AS ok, TRUE AS blocking
FROM (SELECT r_name, CASE WHEN r_name = 'ASIA' THEN 6 ELSE 5 END AS n, COUNT(*) AS s FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) t""")
def _(fx):
    declared = fx.table("region").select(F.col("r_name").alias("province"), F.when(F.col("r_name") == "ASIA", 6).otherwise(5).alias("n"))
    counted = fx.zone_name.groupBy("province", "zone").agg(F.count("*").alias("c"))
    return Q.check_sums(counted, declared, ["province"], "c", "n", "declared_zones", True)


@query("q5_check_zone_count", """
SELECT 'zone_count' AS check_id, CAST(d AS VARCHAR) AS scope, 25.0E0 AS expected, CAST(COUNT(*) AS DOUBLE) AS actual, COUNT(*) = 25 AS ok, FALSE AS blocking FROM fx_zone_day GROUP BY d""")
def _(fx):
    return Q.check_count(fx.zone_day.select("d").distinct().withColumn("n", F.lit(25)), fx.zone_day, "d", "n", "zone_count", False)


@query("q6_check_zone_sums", """
WITH p AS (SELECT province, d, confirmed + CASE WHEN DAY(d) = 4 THEN 1 ELSE 0 END AS n FROM fx_province_history), z AS (SELECT province, d, SUM(cases) AS s FROM fx_zone_history GROUP BY province, d)
SELECT 'zone_sums' AS check_id, p.province || '/' || CAST(p.d AS VARCHAR) AS scope, CAST(n AS DOUBLE) AS expected, CAST(s AS DOUBLE) AS actual, n = s AS ok, FALSE AS blocking FROM p JOIN z ON p.province = z.province AND p.d = z.d""")
def _(fx):
    p = fx.province_history.withColumn("n", F.col("confirmed") + F.when(F.dayofmonth("d") == 4, 1).otherwise(0))
    return Q.check_sums(fx.zone_history, p, ["province", "d"], "cases", "n", "zone_sums", False)


OFFENDERS = """SELECT '{id}' AS check_id, province AS scope, 0.0E0 AS expected, CAST(COUNT(*) FILTER (WHERE {bad}) AS DOUBLE) AS actual, COUNT(*) FILTER (WHERE {bad}) = 0 AS ok, TRUE AS blocking,
 COALESCE(string_agg(label, ', ' ORDER BY label) FILTER (WHERE {bad} AND n <= 5), '') AS offenders
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY province, {bad} ORDER BY label) AS n FROM (SELECT province, zone || ' ' || CAST(d AS VARCHAR) AS label, new_cases - CASE WHEN DAY(d) = 2 THEN 3 ELSE 0 END AS cases, new_deaths AS deaths FROM fx_zone_day) a) b GROUP BY province"""


def shifted(fx):
    return fx.zone_day.select("province", F.concat_ws(" ", "zone", "d").alias("label"), (F.col("new_cases") - F.when(F.dayofmonth("d") == 2, 3).otherwise(0)).alias("cases"), F.col("new_deaths").alias("deaths"))


@query("q7_check_non_negative", OFFENDERS.format(id="non_negative", bad="(cases < 0 OR deaths < 0)"))
def _(fx):
    return Q.check_none(shifted(fx), (F.col("cases") < 0) | (F.col("deaths") < 0), "non_negative", "label", ["province"])


@query("q8_check_deaths_le_cases", OFFENDERS.format(id="deaths_le_cases", bad="(deaths > cases)"))
def _(fx):
    return Q.check_none(shifted(fx), F.col("deaths") > F.col("cases"), "deaths_le_cases", "label", ["province"])


@query("q9_check_last_point", """
WITH l AS (SELECT province, d, confirmed, ROW_NUMBER() OVER (PARTITION BY province ORDER BY d DESC) AS n FROM fx_province_history),
t AS (SELECT province, d AS l, confirmed AS c, CAST(d + INTERVAL 1 DAY * CASE WHEN province = 'ASIA' THEN 1 ELSE 0 END AS DATE) AS sd, confirmed + CASE WHEN province = 'AFRICA' THEN 1 ELSE 0 END AS sc FROM l WHERE n = 1)
SELECT 'last_date' AS check_id, province AS scope, CAST(sd - DATE '1970-01-01' AS DOUBLE) AS expected, CAST(l - DATE '1970-01-01' AS DOUBLE) AS actual, sd = l AS ok, TRUE AS blocking FROM t
UNION ALL SELECT 'last_totals', province, CAST(sc AS DOUBLE), CAST(c AS DOUBLE), sc = c, TRUE FROM t""")
def _(fx):
    last = fx.province_history.groupBy("province").agg(F.max("d").alias("d"), F.max_by("confirmed", "d").alias("confirmed"))
    snap = last.select("province", F.date_add("d", F.when(F.col("province") == "ASIA", 1).otherwise(0)).alias("d"), (F.col("confirmed") + F.when(F.col("province") == "AFRICA", 1).otherwise(0)).alias("confirmed"))
    return Q.check_last_point(fx.province_history, snap, "province", ["confirmed"])


@query("q10_check_unique_dates", """
SELECT 'unique_dates' AS check_id, province AS scope, CAST(COUNT(*) AS DOUBLE) AS expected, CAST(COUNT(DISTINCT d) AS DOUBLE) AS actual, COUNT(*) = COUNT(DISTINCT d) AS ok, TRUE AS blocking FROM fx_zone_day GROUP BY province""")
def _(fx):
    return Q.check_unique_dates(fx.zone_day, ["province"])


@query("q11_check_monotone", """
WITH t AS (SELECT YEAR(d) AS y, d, COALESCE(COALESCE(confirmed, 0) < LAG(COALESCE(confirmed, 0)) OVER (PARTITION BY YEAR(d) ORDER BY d), FALSE) AS dr FROM fx_sitreps),
u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY y, dr ORDER BY d) AS n FROM t)
SELECT 'monotone' AS check_id, CAST(y AS VARCHAR) AS scope, 0.0E0 AS expected, CAST(COUNT(*) FILTER (WHERE dr) AS DOUBLE) AS actual, COUNT(*) FILTER (WHERE dr) = 0 AS ok, FALSE AS blocking,
 COALESCE(string_agg(CAST(d AS VARCHAR), ', ' ORDER BY d) FILTER (WHERE dr AND n <= 3), '') AS offenders FROM u GROUP BY y""")
def _(fx):
    return Q.check_monotone(fx.sitreps.withColumn("y", F.year("d").cast("string")), "confirmed", ["y"])


@query("q12_check_last_snapshot", """
WITH l AS (SELECT province, MAX(d) AS d FROM fx_zone_history GROUP BY province), s AS (SELECT h.province, SUM(h.cases) AS c FROM fx_zone_history h JOIN l ON h.province = l.province AND h.d = l.d GROUP BY h.province),
t AS (SELECT province, SUM(cases) AS c FROM (SELECT province, zone, MAX(cases) AS cases FROM fx_zone_history GROUP BY province, zone) x GROUP BY province)
SELECT 'snapshot_total' AS check_id, t.province AS scope, CAST(t.c AS DOUBLE) AS expected, CAST(s.c AS DOUBLE) AS actual, t.c = s.c AS ok, FALSE AS blocking FROM t JOIN s ON t.province = s.province""")
def _(fx):
    last = fx.zone_history.groupBy("province").agg(F.max("d").alias("d"))
    top = fx.zone_history.groupBy("province", "zone").agg(F.max("cases").alias("cases")).groupBy("province").agg(F.sum("cases").alias("n"))
    return Q.check_sums(fx.zone_history.join(last, ["province", "d"]), top, ["province"], "cases", "n", "snapshot_total", False)


@query("q13_check_history_covers", """
SELECT 'history_covers' AS check_id, CAST(s.d AS VARCHAR) AS scope, 1.0E0 AS expected, CASE WHEN h.d IS NULL THEN 0.0E0 ELSE 1.0E0 END AS actual, h.d IS NOT NULL AS ok, TRUE AS blocking
FROM fx_sitreps s LEFT JOIN (SELECT DISTINCT d FROM fx_province_history WHERE province = 'ASIA') h ON s.d = h.d""")
def _(fx):
    return Q.check_covers(fx.province_history.where("province = 'ASIA'"), fx.sitreps)


@query("q14_check_reports", """
WITH r AS (SELECT CAST(page_id % 200 AS VARCHAR) AS sitrep, url AS file FROM pages)
SELECT 'current_listed' AS check_id, 'reports' AS scope, 1.0E0 AS expected, CAST(COUNT(*) FILTER (WHERE sitrep = '7') AS DOUBLE) AS actual, COUNT(*) FILTER (WHERE sitrep = '7') > 0 AS ok, TRUE AS blocking FROM r
UNION ALL SELECT 'ids_unique', 'reports', CAST(COUNT(*) AS DOUBLE), CAST(COUNT(DISTINCT sitrep) AS DOUBLE), COUNT(*) = COUNT(DISTINCT sitrep), TRUE FROM r
UNION ALL SELECT 'files_exist', 'reports', 0.0E0, CAST(COUNT(*) AS DOUBLE), COUNT(*) = 0, TRUE FROM r WHERE file NOT IN (SELECT url FROM pages WHERE page_id % 50 <> 0)""")
def _(fx):
    p = fx.table("pages")
    return Q.check_reports(p.select((F.col("page_id") % 200).cast("string").alias("sitrep"), F.col("url").alias("file")), p.where("page_id % 50 <> 0").select(F.col("url").alias("file")), "7")


@query("q15_verdict", Q1 + "SELECT COUNT(*) FILTER (WHERE NOT ok AND blocking) = 0 AS passed, COUNT(*) FILTER (WHERE NOT ok AND blocking) AS blocking_failures, COUNT(*) FILTER (WHERE NOT ok AND NOT blocking) AS warnings FROM q")
def _(fx):
    return Q.verdict(rollup_check(fx))


@query("q15_gate", """
WITH z AS (SELECT province, zone, d, cases - CASE WHEN DAY(d) = 2 THEN 3 ELSE 0 END AS cases, deaths FROM fx_zone_history),
p AS (SELECT province, d, SUM(cases) + CASE WHEN DAY(d) = 4 THEN 1 ELSE 0 END AS cases, SUM(deaths) AS deaths, COUNT(*) AS zones FROM fx_zone_history GROUP BY province, d),
q AS (SELECT *, CASE WHEN cases > 0 THEN ROUND(100.0E0 * deaths / cases, 1) END AS own FROM p),
pr AS (SELECT *, own + CASE WHEN DAY(d) = 8 THEN 0.2E0 ELSE 0.0E0 END AS cfr FROM q),
n AS (SELECT d, SUM(cases) AS cases, SUM(deaths) + CASE WHEN DAY(d) = 6 THEN 1 ELSE 0 END AS deaths, SUM(zones) + CASE WHEN DAY(d) = 9 THEN 1 ELSE 0 END AS zones, 50.0E0 AS cfr FROM p GROUP BY d),
s AS (SELECT d, SUM(p.cases) AS cases, SUM(p.deaths) AS deaths, SUM(p.zones) AS zones FROM p GROUP BY d),
zs AS (SELECT d, province, SUM(cases) AS cases FROM z GROUP BY d, province), zn AS (SELECT d, COUNT(*) AS n FROM z GROUP BY d),
c AS (SELECT 'rollup_cases' AS check_id, CAST(n.d AS VARCHAR) AS scope, n.cases AS e, s.cases AS a, TRUE AS blocking FROM n JOIN s ON n.d = s.d
  UNION ALL SELECT 'rollup_deaths', CAST(n.d AS VARCHAR), n.deaths, s.deaths, TRUE FROM n JOIN s ON n.d = s.d
  UNION ALL SELECT 'declared_zones', CAST(n.d AS VARCHAR), n.zones, s.zones, TRUE FROM n JOIN s ON n.d = s.d
  UNION ALL SELECT 'zone_count', CAST(s.d AS VARCHAR), s.zones, zn.n, FALSE FROM s JOIN zn ON zn.d = s.d
  UNION ALL SELECT 'zone_sums', CAST(p.d AS VARCHAR) || '/' || p.province, p.cases, zs.cases, FALSE FROM p JOIN zs ON p.d = zs.d AND p.province = zs.province),
r AS (SELECT 'rate' AS check_id, CAST(d AS VARCHAR) AS scope, ROUND(100.0E0 * deaths / cases, 1) AS e, cfr AS a, 0.1E0 AS slack FROM n WHERE cases > 0
  UNION ALL SELECT 'rate', CAST(d AS VARCHAR) || '/' || province, own, cfr, 0.15E0 FROM pr WHERE cases > 0)
SELECT check_id, scope, CAST(e AS DOUBLE) AS expected, CAST(a AS DOUBLE) AS actual, e = a AS ok, blocking FROM c
UNION ALL SELECT check_id, scope, e, a, ABS(e - a) <= slack + 1E-9, TRUE FROM r
UNION ALL SELECT 'non_negative', CAST(d AS VARCHAR) || '/' || province || '/' || zone, 0.0E0, CAST(LEAST(cases, deaths) AS DOUBLE), FALSE, TRUE FROM z WHERE LEAST(cases, deaths) < 0
UNION ALL SELECT 'deaths_le_cases', CAST(d AS VARCHAR) || '/' || province || '/' || zone, CAST(cases AS DOUBLE), CAST(deaths AS DOUBLE), FALSE, TRUE FROM z WHERE deaths > cases""")
def _(fx):
    on = lambda n, x: F.when(F.dayofmonth("d") == n, x).otherwise(0)
    h = fx.zone_history
    zones = h.withColumn("cases", F.col("cases") - on(2, 3))
    p = h.groupBy("province", "d").agg((F.sum("cases") + on(4, 1)).alias("cases"), F.sum("deaths").alias("deaths"), F.count("*").alias("zones"))
    own = F.round(100.0 * F.col("deaths") / F.when(F.col("cases") > 0, F.col("cases")), 1)
    n = p.groupBy("d").agg(F.sum("cases").alias("cases"), (F.sum("deaths") + on(6, 1)).alias("deaths"), (F.sum("zones") + on(9, 1)).alias("zones"), F.lit(50.0).alias("cfr"))
    return Q.gate(zones, p.withColumn("cfr", own + on(8, 0.2)), n, "d")


@query("a9_stage_success", """
WITH g AS (SELECT doc_id + 1 AS number, doc_id % 3 <> 0 AS identity, doc_id % 7 <> 0 AS totals FROM documents),
l AS (SELECT number, 'identity' AS stage, identity AS fine FROM g UNION ALL SELECT number, 'totals', totals FROM g)
SELECT stage, CAST((number - 1) // 10 * 10 + 1 AS BIGINT) AS bucket, COUNT(*) AS n, COUNT(*) FILTER (WHERE fine) AS ok, COALESCE(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (WHERE NOT fine), '') AS failed FROM l GROUP BY 1, 2""")
def _(fx):
    k = F.col("doc_id")
    return Q.stage_success(fx.table("documents").select((k + 1).alias("number"), (k % 3 != 0).alias("identity"), (k % 7 != 0).alias("totals")), ["identity", "totals"])


@query("a10_outcome_counts", "SELECT source, COUNT(*) AS n FROM documents GROUP BY source")
def _(fx):
    return Q.outcome_counts(fx.table("documents"), "source")


@query("a11_shared_ids", """
SELECT id, string_agg(d, ',' ORDER BY d) AS dates FROM (SELECT DISTINCT zone || CAST(new_cases AS VARCHAR) AS id, CAST(d AS VARCHAR) AS d FROM fx_zone_day WHERE new_cases > 1) t GROUP BY id HAVING COUNT(*) > 1""")
def _(fx):
    r = fx.zone_day.where("new_cases > 1").select(F.concat("zone", F.col("new_cases").cast("string")).alias("id"), F.col("d").cast("string").alias("d"))
    return Q.shared_ids(r, "id").withColumn("dates", F.concat_ws(",", "dates"))


@query("u4_expected_range", """
SELECT n AS number, n IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) AS present FROM (SELECT UNNEST(generate_series(CAST(1 AS BIGINT), (SELECT MAX(doc_id) FROM documents))) AS n) t""")
def _(fx):
    top = fx.table("documents").agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]  # one value; an empty table has no range
    return Q.expected_range(fx.table("documents").where("doc_id % 3 <> 0"), "doc_id", 1, top)


@query("u5_explain_missing", """
SELECT s.d, CASE WHEN DAY(s.d) = 19 THEN 'no report' WHEN DAY(s.d) = 6 THEN 'no section' ELSE 'recoverable' END AS why
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) s WHERE s.d NOT IN (SELECT d FROM fx_contacts)""")
def _(fx):
    days = fx.sql("SELECT DISTINCT CAST(ts AS DATE) AS d FROM events")
    return Q.explain_missing(days, fx.contacts, days.where(F.dayofmonth("d") != 19).withColumn("has_section", F.dayofmonth("d") != 6))
