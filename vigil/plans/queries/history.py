"""Queries of histories and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.functions.session import shared_dir
from vigil.operators import history as H
from vigil.operators import match as M
from vigil.plans.registry import query
from vigil.streaming import ingest as I

UPDATES = """SELECT province, d, confirmed + 1 AS confirmed FROM fx_province_history WHERE DAY(d) = 5
UNION ALL SELECT province, d + INTERVAL 10000 DAY, confirmed FROM fx_province_history WHERE DAY(d) = 5 AND MONTH(d) = 1"""


def updates(fx):
    h = fx.province_history.where(F.dayofmonth("d") == 5)
    return h.withColumn("confirmed", F.col("confirmed") + 1).unionByName(h.where(F.month("d") == 1).withColumn("d", F.date_add("d", 10000)))


@query("s6_upsert", f"""
WITH u AS (SELECT province, CAST(d AS DATE) AS d, confirmed FROM ({UPDATES}) q)
SELECT province, d, confirmed FROM u UNION ALL SELECT h.province, h.d, h.confirmed FROM fx_province_history h WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.province = h.province AND u.d = h.d)""")
def _(fx):
    return H.upsert(fx.province_history, updates(fx), ["province", "d"])


@query("s6_upsert_series", """
WITH u AS (SELECT d, CASE WHEN DAY(d) = 6 THEN NULL ELSE confirmed + 2 END AS confirmed, deaths, CASE WHEN DAY(d) = 5 THEN CAST(NULL AS BIGINT) ELSE CAST(1 AS BIGINT) END AS recovered FROM fx_sitreps WHERE DAY(d) BETWEEN 5 AND 7)
SELECT s.d, CASE WHEN u.confirmed IS NOT NULL THEN u.confirmed ELSE s.confirmed END AS confirmed, s.deaths,
  CASE WHEN u.confirmed IS NOT NULL THEN COALESCE(u.recovered, s.recovered) ELSE s.recovered END AS recovered FROM fx_sitreps s LEFT JOIN u ON s.d = u.d""")
def _(fx):
    s = fx.sitreps
    u = s.where(F.dayofmonth("d").between(5, 7))
    u = u.withColumns({"confirmed": F.when(F.dayofmonth("d") != 6, F.col("confirmed") + 2), "recovered": F.when(F.dayofmonth("d") != 5, F.lit(1).cast("bigint"))})
    return H.upsert_series(s, u, ["d"])


@query("s7_upsert_with_provenance", """
WITH p AS (SELECT d, rate, CASE WHEN DAY(d) % 3 = 0 THEN 'INSP SitRep' WHEN DAY(d) % 3 = 1 THEN 'manual' END AS source FROM fx_contacts),
f AS (SELECT d, rate + 1 AS rate, 'INSP SitRep' AS source FROM fx_contacts WHERE DAY(d) % 4 = 0)
SELECT * FROM f UNION ALL SELECT * FROM p WHERE (source IS NULL OR source NOT LIKE '%INSP%') AND d NOT IN (SELECT d FROM f)""")
def _(fx):
    day = F.dayofmonth("d")
    p = fx.contacts.withColumn("source", F.when(day % 3 == 0, "INSP SitRep").when(day % 3 == 1, "manual"))
    f = fx.contacts.where(day % 4 == 0).select("d", (F.col("rate") + 1).alias("rate"), F.lit("INSP SitRep").alias("source"))
    return H.upsert_with_provenance(p, f, ["d"], "%INSP%")


@query("s8_upsert_conflicts", """
SELECT province, MONTH(d) AS m, COUNT(DISTINCT confirmed) AS n, MIN(confirmed) AS low, MAX(confirmed) AS high FROM fx_province_history WHERE YEAR(d) = 1995 AND DAY(d) < 3
GROUP BY province, MONTH(d) HAVING COUNT(DISTINCT confirmed) > 1""")
def _(fx):
    rows = fx.province_history.where((F.year("d") == 1995) & (F.dayofmonth("d") < 3)).withColumn("m", F.month("d").cast("bigint"))
    out = H.upsert_conflicts(rows, ["province", "m"], "confirmed")
    return out.select("province", "m", F.size("values").cast("bigint").alias("n"), F.array_min("values").alias("low"), F.array_max("values").alias("high"))


@query("s9_needs_parse", """
SELECT doc_id AS sitrep FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR (doc_id % 3 = 0 AND doc_id % 2 = 1)""")
def _(fx):
    docs = fx.table("documents").select(F.col("doc_id").alias("sitrep"))
    k = F.col("sitrep")
    index = docs.where(k % 7 != 0).select("sitrep", F.when(k % 5 != 0, F.lit("2026-01-01")).alias("reporting_date"), F.when(k % 3 != 0, k).alias("confirmed"), F.when(k % 2 == 0, True).alias("confirmed_extraction_failed"))
    return H.needs_parse(docs, index)


@query("w7_carry_forward", """
WITH r AS (SELECT DISTINCT d FROM fx_zone_history), n AS (SELECT province, zone, MIN(d) AS first FROM fx_zone_history GROUP BY province, zone),
g AS (SELECT r.d, n.province, n.zone, h.cases, h.deaths, h.d AS seen FROM r JOIN n ON r.d >= n.first LEFT JOIN fx_zone_history h ON h.d = r.d AND h.zone = n.zone AND h.province = n.province)
SELECT province, zone, d, LAST_VALUE(cases IGNORE NULLS) OVER w AS cases, LAST_VALUE(deaths IGNORE NULLS) OVER w AS deaths, seen IS NULL AS carried
FROM g WINDOW w AS (PARTITION BY province, zone ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(fx):
    h = fx.zone_history
    return H.carry_forward(h, h.select("d"), ["province", "zone"], ["cases", "deaths"])


@query("w8_never_seen", """
SELECT province, zone, MIN(d) AS d FROM fx_zone_history GROUP BY province, zone HAVING MIN(d) > (SELECT MIN(d) FROM fx_zone_history)""")
def _(fx):
    return H.never_seen(fx.zone_history.withColumn("outbreak", F.lit("o1")), ["province", "zone"], ["outbreak"]).drop("outbreak")


@query("w18_snapshot_at", """
SELECT province, zone, d, cases, deaths FROM fx_zone_history h WHERE d = (SELECT MAX(d) FROM fx_zone_history x WHERE x.province = h.province AND d <= DATE '1999-12-26')""")
def _(fx):
    return H.snapshot_at(fx.zone_history, F.lit("1999-12-26").cast("date"), ["province"])


@query("j7_snapshot_delta", """
WITH r AS (SELECT d, LAG(d) OVER (ORDER BY d) AS b FROM (SELECT DISTINCT d FROM fx_zone_history) t)
SELECT h.province, h.zone, h.d, h.cases, h.deaths, GREATEST(0, h.cases - COALESCE(o.cases, 0)) AS new_cases, GREATEST(0, h.deaths - COALESCE(o.deaths, 0)) AS new_deaths
FROM fx_zone_history h JOIN r ON h.d = r.d LEFT JOIN fx_zone_history o ON o.d = r.b AND o.zone = h.zone AND o.province = h.province""")
def _(fx):
    h = fx.zone_history.withColumn("outbreak", F.lit("o1"))
    return H.snapshot_delta(h, ["province", "zone"], ["cases", "deaths"], ["outbreak"]).drop("outbreak")


@query("j8_live_overlay", """
SELECT h.province, h.zone, h.cases, COALESCE(l.new_cases, 0) AS new_cases FROM (SELECT province, zone, MAX(cases) AS cases FROM fx_zone_history GROUP BY province, zone) h
LEFT JOIN (SELECT province, zone, new_cases FROM fx_zone_day WHERE d = (SELECT MAX(d) FROM fx_zone_day)) l ON h.zone = l.zone AND h.province = l.province""")
def _(fx):
    last = fx.zone_day.agg(F.max("d").alias("d"))
    live = fx.zone_day.join(last, "d").select("province", "zone", "new_cases")
    return H.live_overlay(fx.zone_history.groupBy("province", "zone").agg(F.max("cases").alias("cases")), live, ["province", "zone"], ["new_cases"])


@query("j9_complete_from_history", """
WITH l AS (SELECT h.province, h.zone, h.cases, h.deaths, z.new_cases FROM fx_zone_history h JOIN fx_zone_day z ON z.zone = h.zone AND z.province = h.province AND z.d = h.d WHERE h.d = (SELECT MAX(d) FROM fx_zone_history)),
t AS (SELECT province, zone, MAX(cases) AS cases, MAX(deaths) AS deaths FROM fx_zone_history GROUP BY province, zone)
SELECT province, zone, cases, deaths, CASE WHEN cases > 0 THEN ROUND(100.0E0 * deaths / cases, 1) ELSE 0.0E0 END AS cfr, new_cases FROM l
UNION ALL SELECT province, zone, cases, deaths, CASE WHEN cases > 0 THEN ROUND(100.0E0 * deaths / cases, 1) ELSE 0.0E0 END, CAST(0 AS BIGINT) FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.zone = t.zone AND l.province = t.province)""")
def _(fx):
    last = fx.zone_history.agg(F.max("d").alias("d"))
    rate = F.when(F.col("cases") > 0, F.round(100.0 * F.col("deaths") / F.col("cases"), 1)).otherwise(F.lit(0.0))
    live = fx.zone_history.join(last, "d").join(fx.zone_day.select("province", "zone", "d", "new_cases"), ["province", "zone", "d"])
    live = live.select("province", "zone", "cases", "deaths", rate.alias("cfr"), "new_cases")
    top = fx.zone_history.groupBy("province", "zone").agg(F.max("cases").alias("cases"), F.max("deaths").alias("deaths"))
    return H.complete_from_history(live, top, ["province", "zone"], ["new_cases"])


@query("a13_dedupe_last", """
SELECT province, zone, d, cases, deaths FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY province, zone ORDER BY d DESC) AS n FROM fx_zone_history) t WHERE n = 1""")
def _(fx):
    return H.dedupe_last(fx.zone_history, ["province", "zone"], [F.col("d")])


@query("u2_diff_versions", """
WITH n AS (SELECT d, CASE WHEN DAY(d) % 5 = 0 THEN rate + 1 WHEN DAY(d) % 7 = 0 THEN NULL ELSE rate END AS rate FROM fx_contacts WHERE DAY(d) % 4 <> 0
  UNION ALL SELECT CAST(d + INTERVAL 100 DAY AS DATE), rate FROM fx_contacts WHERE DAY(d) % 6 = 0)
SELECT COALESCE(o.d, n.d) AS d, o.rate AS old_value, n.rate AS new_value, CASE WHEN o.d IS NULL THEN 'added' WHEN n.d IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM fx_contacts o FULL JOIN n ON o.d = n.d WHERE o.d IS NULL OR n.d IS NULL OR o.rate IS DISTINCT FROM n.rate""")
def _(fx):
    day = F.dayofmonth("d")
    c = fx.contacts
    new = c.where(day % 4 != 0).withColumn("rate", F.when(day % 5 == 0, F.col("rate") + 1).when(day % 7 == 0, None).otherwise(F.col("rate")))
    return H.diff_versions(c, new.unionByName(c.where(day % 6 == 0).withColumn("d", F.date_add("d", 100))), ["d"], "rate")


@query("t2_recompute_from", """
WITH r AS (SELECT DISTINCT d FROM fx_zone_history), n AS (SELECT province, zone, MIN(d) AS first FROM fx_zone_history GROUP BY province, zone),
g AS (SELECT r.d, n.province, n.zone, h.cases, h.d AS seen FROM r JOIN n ON r.d >= n.first LEFT JOIN fx_zone_history h ON h.d = r.d AND h.zone = n.zone AND h.province = n.province),
f AS (SELECT province, zone, d, LAST_VALUE(cases IGNORE NULLS) OVER (PARTITION BY province, zone ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cases, seen IS NULL AS carried FROM g)
SELECT * FROM f WHERE d >= (SELECT MIN(d) FROM fx_zone_history WHERE DAY(d) = 29 AND YEAR(d) = 2000)""")
def _(fx):
    h = fx.zone_history
    return H.recompute_from(h, h.where((F.dayofmonth("d") == 29) & (F.year("d") == 2000)), ["province", "zone"], ["cases"])


@query("t2_late_report", """
WITH h AS (SELECT province, zone, d, cases FROM fx_zone_history), r AS (SELECT DISTINCT d FROM h), n AS (SELECT province, zone, MIN(d) AS first FROM h GROUP BY province, zone),
g AS (SELECT r.d, n.province, n.zone, h.cases, h.d AS seen FROM r JOIN n ON r.d >= n.first LEFT JOIN h ON h.d = r.d AND h.zone = n.zone AND h.province = n.province),
f AS (SELECT province, zone, d, LAST_VALUE(cases IGNORE NULLS) OVER (PARTITION BY province, zone ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cases, seen IS NULL AS carried FROM g)
SELECT * FROM f WHERE d >= (SELECT MIN(d) FROM h WHERE DAY(d) = 29 AND YEAR(d) >= 1999)""")
def _(fx):
    """The history without some reports, then these, late: what they change is returned."""
    h = fx.zone_history.select("province", "zone", "d", "cases")
    late = (F.dayofmonth("d") == 29) & (F.year("d") >= 1999)
    root = f"{shared_dir(fx.spark)}/reports-{uuid.uuid4().hex}"
    I.put_reports(fx.spark, root, h.where(~late), ["province", "zone"], ["cases"])
    return I.put_reports(fx.spark, root, h.where(late), ["province", "zone"], ["cases"])


@query("j1_join_zone", """
SELECT a.province, a.zone, a.d, a.cases, n.n_nationkey AS code FROM fx_zone_history a JOIN nation n ON a.zone = n.n_name""")
def _(fx):
    other = fx.sql("SELECT LOWER(n_name) AS zone, r_name AS province, n_nationkey AS code FROM nation JOIN region ON n_regionkey = r_regionkey")
    return M.join_zone(fx.zone_history.select("province", "zone", "d", "cases"), other)


SIDES = r"regexp_replace(lower(regexp_replace(zone, '\*', '')), '[^a-z0-9]+', '', 'g')"


@query("j2_resolve_zone", r"""
WITH o AS (SELECT province, spelled AS zone, CASE WHEN spelled = 'Other NATION_3 area' THEN 'nation4' ELSE regexp_replace(lower(spelled), '[^a-z0-9]+', '', 'g') END AS k FROM fx_zone_alias WHERE spelled <> 'nation_4*' UNION ALL SELECT 'ASIA', 'ALGERIA', 'algeria'),
r AS (SELECT province, zone, regexp_replace(lower(zone), '[^a-z0-9]+', '', 'g') AS k FROM fx_zone_name UNION ALL SELECT 'ASIA', 'Algeria', 'algeria'),
oc AS (SELECT *, COUNT(*) OVER (PARTITION BY k) AS n, COUNT(*) OVER (PARTITION BY k, province) AS np FROM o), rc AS (SELECT *, COUNT(*) OVER (PARTITION BY k) AS n, COUNT(*) OVER (PARTITION BY k, province) AS np FROM r)
SELECT oc.zone, oc.province, rc.zone AS matched FROM oc LEFT JOIN rc ON oc.k = rc.k AND ((oc.n = 1 AND rc.n = 1) OR (oc.province = rc.province AND oc.np = 1 AND rc.np = 1))""")
def _(fx):
    ours = fx.zone_alias.where("spelled <> 'nation_4*'").select("province", F.col("spelled").alias("zone")).unionByName(fx.spark.sql("SELECT 'ASIA' AS province, 'ALGERIA' AS zone"))
    ref = fx.zone_name.select("province", "zone").unionByName(fx.spark.sql("SELECT 'ASIA' AS province, 'Algeria' AS zone"))
    return M.resolve_zone(ours, ref, {"other nation-3 area": "Nation 4"})


@query("j3_fuzzy_match", r"""
WITH o AS (SELECT province, spelled, regexp_replace(lower(spelled), '[^a-z0-9]+', '', 'g') AS k FROM fx_zone_alias),
r AS (SELECT province, zone, regexp_replace(lower(zone), '[^a-z0-9]+', '', 'g') AS k FROM fx_zone_name),
e AS (SELECT o.spelled AS zone, o.province, o.k, (SELECT MIN(zone) FROM r WHERE r.k = o.k) AS matched FROM o),
f AS (SELECT e.zone, e.province, r.zone AS m, levenshtein(e.k, r.k) AS dist, ROW_NUMBER() OVER (PARTITION BY e.zone, e.province ORDER BY levenshtein(e.k, r.k), r.zone) AS n FROM e JOIN r ON e.province = r.province WHERE e.matched IS NULL AND levenshtein(e.k, r.k) <= 2)
SELECT e.zone, e.province, COALESCE(e.matched, f.m) AS matched, CASE WHEN e.matched IS NOT NULL THEN 0 ELSE CAST(f.dist AS INT) END AS distance,
 CASE WHEN e.matched IS NOT NULL THEN 'exact' WHEN f.m IS NOT NULL THEN 'spelling' ELSE 'missing' END AS status FROM e LEFT JOIN f ON e.zone = f.zone AND e.province = f.province AND f.n = 1""")
def _(fx):
    return M.fuzzy_match(fx.zone_alias.select("province", F.col("spelled").alias("zone")), fx.zone_name.select("province", "zone"))


@query("j4_name_candidates", r"""
WITH o AS (SELECT province, spelled AS zone, regexp_replace(lower(spelled), '[^a-z0-9]+', '', 'g') AS k FROM fx_zone_alias),
s AS (SELECT o.zone, o.province, r.zone AS candidate, ROUND(1 - levenshtein(o.k, regexp_replace(lower(r.zone), '[^a-z0-9]+', '', 'g')) * 1.0E0 / GREATEST(LENGTH(o.k), LENGTH(regexp_replace(lower(r.zone), '[^a-z0-9]+', '', 'g'))), 6) AS score FROM o JOIN fx_zone_name r ON o.province = r.province),
t AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY zone, province ORDER BY score DESC, candidate) AS INT) AS rank FROM s WHERE score >= 0.6) SELECT zone, province, candidate, score, rank FROM t WHERE rank <= 3""")
def _(fx):
    return M.name_candidates(fx.zone_alias.select("province", F.col("spelled").alias("zone")), fx.zone_name.select("province", "zone"))


@query("j5_asof_join", """
SELECT e.province, e.d, e.value, s.d AS asof_date, s.confirmed FROM (SELECT province, CAST(d + INTERVAL 1 DAY AS DATE) AS d, new_cases AS value FROM fx_zone_day WHERE DAY(d) % 3 = 0) e
ASOF LEFT JOIN (SELECT * FROM fx_province_history WHERE confirmed % 5 <> 0) s ON e.province = s.province AND e.d >= s.d""")
def _(fx):
    events = fx.zone_day.where(F.dayofmonth("d") % 3 == 0).select("province", F.date_add("d", 1).alias("d"), F.col("new_cases").alias("value"))
    series = fx.province_history.withColumn("confirmed", F.when(F.col("confirmed") % 5 != 0, F.col("confirmed")))
    return M.asof_join(events, series, ["province"], ["confirmed"], known="confirmed")


@query("j6_cumulative_at", """
WITH i AS (SELECT zone, d, SUM(new_cases) OVER (PARTITION BY zone ORDER BY d) AS total FROM fx_zone_day WHERE DAY(d) % 4 = 0),
q AS (SELECT DISTINCT zone, CAST(DATE_TRUNC('month', d) AS DATE) AS d FROM fx_zone_day)
SELECT q.zone, q.d, CAST(COALESCE(i.total, 0) AS BIGINT) AS total FROM q ASOF LEFT JOIN i ON q.zone = i.zone AND q.d >= i.d""")
def _(fx):
    dates = fx.zone_day.select("zone", F.trunc("d", "month").alias("d")).distinct()
    return M.cumulative_at(fx.zone_day.where(F.dayofmonth("d") % 4 == 0), dates, "new_cases", ["zone"])


@query("j10_canonical_province", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE province END AS province FROM fx_customer_name""")
def _(fx):
    spelled = F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(F.replace(F.lower("province"), F.lit(" "), F.lit("-")))
    return M.canonical_province(fx.customer_name.select("c_custkey", spelled.alias("province")), fx.table("region").select(F.col("r_name").alias("canonical")))


@query("j11_validate_against", """
SELECT e.d, e.confirmed, CASE WHEN s.d IS NULL OR s.confirmed IS NULL THEN 'no trusted value' WHEN e.confirmed <> s.confirmed THEN 'differs' END AS reason
FROM (SELECT d, confirmed + CASE WHEN DAY(d) % 9 = 0 THEN 1 ELSE 0 END AS confirmed FROM fx_sitreps) e LEFT JOIN (SELECT * FROM fx_sitreps WHERE DAY(d) <> 20) s ON e.d = s.d""")
def _(fx):
    e = fx.sitreps.select("d", (F.col("confirmed") + F.when(F.dayofmonth("d") % 9 == 0, 1).otherwise(0)).alias("confirmed"))
    return M.validate_against(e, fx.sitreps.where(F.dayofmonth("d") != 20), ["d"], "confirmed")
