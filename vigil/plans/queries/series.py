"""Queries of the series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import series as S
from vigil.plans.fixtures import Fixtures
from vigil.plans.registry import query

O = ["outbreak"]


def national(fx: Fixtures) -> DataFrame:
    return fx.sitreps.withColumn("outbreak", F.lit("o1"))


INCREMENTS = """
WITH k AS (SELECT d, confirmed, deaths FROM fx_sitreps),
i AS (SELECT d, confirmed, deaths,
        GREATEST(0, confirmed - LAG(confirmed) OVER (ORDER BY d)) AS inc,
        deaths - LAST_VALUE(deaths IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dd FROM k),
n AS (SELECT d, confirmed, deaths, CASE WHEN LAG(confirmed) OVER (ORDER BY d) IS NOT NULL THEN inc END AS new_confirmed,
        CASE WHEN dd IS NOT NULL THEN GREATEST(0, dd) END AS new_deaths FROM i)
"""


def with_increments(fx: Fixtures) -> DataFrame:
    df = S.increments(national(fx), "confirmed", O, out="new_confirmed")
    return S.increments(df, "deaths", O, out="new_deaths")


@query("w1_increments", INCREMENTS + "SELECT d, new_confirmed, new_deaths FROM n")
def _(fx):
    return with_increments(fx).select("d", "new_confirmed", "new_deaths")


@query("w1_increments_by_zone", """
SELECT province, zone, d, CASE WHEN LAG(cases) OVER w IS NOT NULL THEN GREATEST(0, cases - LAG(cases) OVER w) END AS increment
FROM fx_zone_history WINDOW w AS (PARTITION BY province, zone ORDER BY d)""")
def _(fx):
    return S.increments(fx.zone_history, "cases", ["province", "zone"]).select("province", "zone", "d", "increment")


@query("w2_split_catchup", INCREMENTS + """,
o AS (SELECT d, CAST(3 AS BIGINT) AS ov FROM fx_sitreps WHERE DAY(d) = 14)
SELECT n.d, n.new_confirmed, CASE WHEN ov IS NULL OR new_confirmed IS NULL THEN new_confirmed ELSE LEAST(ov, new_confirmed) END AS reported,
       CASE WHEN ov IS NULL OR new_confirmed IS NULL THEN CAST(0 AS BIGINT) ELSE GREATEST(0, new_confirmed - ov) END AS catchup,
       CASE WHEN confirmed > 0 THEN ROUND(100.0E0 * deaths / confirmed, 1) END AS cfr
FROM n LEFT JOIN o ON n.d = o.d""")
def w2_split_catchup(fx):
    over = national(fx).where(F.dayofmonth("d") == 14).select("outbreak", "d", F.lit(3).cast("bigint").alias("override"))
    df = S.split_catchup(with_increments(fx), over, ["outbreak", "d"], "new_confirmed")
    return df.select("d", "new_confirmed", "reported", "catchup", S.cfr(F.col("deaths"), F.col("confirmed")).alias("cfr"))


@query("w3_last_known", """
SELECT * FROM (SELECT confirmed AS last_confirmed, d AS last_confirmed_date FROM fx_sitreps WHERE confirmed IS NOT NULL ORDER BY d DESC LIMIT 1) a,
 (SELECT deaths AS last_deaths, d AS last_deaths_date FROM fx_sitreps WHERE deaths IS NOT NULL ORDER BY d DESC LIMIT 1) b,
 (SELECT recovered AS last_recovered, d AS last_recovered_date FROM fx_sitreps WHERE recovered IS NOT NULL ORDER BY d DESC LIMIT 1) c,
 (SELECT confirmed AS previous_confirmed FROM fx_sitreps WHERE confirmed IS NOT NULL ORDER BY d DESC LIMIT 1 OFFSET 1) e,
 (SELECT deaths AS previous_deaths FROM fx_sitreps WHERE deaths IS NOT NULL ORDER BY d DESC LIMIT 1 OFFSET 1) f,
 (SELECT recovered AS previous_recovered FROM fx_sitreps WHERE recovered IS NOT NULL ORDER BY d DESC LIMIT 1 OFFSET 1) g""")
def _(fx):
    return S.last_known(national(fx), ["confirmed", "deaths", "recovered"], O).drop("outbreak")


@query("w4_kpi_delta", """
WITH r AS (SELECT province, d, confirmed, ROW_NUMBER() OVER (PARTITION BY province ORDER BY d DESC) AS n FROM fx_province_history)
SELECT a.province, a.confirmed AS last_confirmed, b.confirmed AS previous_confirmed, GREATEST(0, a.confirmed - b.confirmed) AS delta_confirmed
FROM r a JOIN r b ON a.province = b.province AND a.n = 1 AND b.n = 2""")
def _(fx):
    last = S.last_known(fx.province_history, ["confirmed"], ["province"])
    return S.kpi_delta(last, "confirmed").select("province", "last_confirmed", "previous_confirmed", "delta_confirmed")


def contacts(fx: Fixtures) -> DataFrame:
    return fx.contacts.withColumn("outbreak", F.lit("o1"))


DAYS = """WITH e AS (SELECT MIN(d) AS a, MAX(d) AS b FROM fx_contacts),
x AS (SELECT CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM e),
y AS (SELECT x.d, c.rate FROM x LEFT JOIN fx_contacts c ON x.d = c.d)
"""


@query("w5_densify", DAYS + "SELECT d, rate FROM y")
def _(fx):
    return S.densify(contacts(fx), O).select("d", "rate")


@query("w6_bridge_gaps", DAYS + """, z AS (SELECT d, rate,
  LAST_VALUE(CASE WHEN rate IS NOT NULL THEN d END IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
  LAST_VALUE(rate IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
  FIRST_VALUE(CASE WHEN rate IS NOT NULL THEN d END IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1,
  FIRST_VALUE(rate IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM y)
SELECT d, rate, ROUND(CASE WHEN rate IS NOT NULL THEN rate ELSE v0 + (v1 - v0) * ((d - d0) * 1.0E0 / (d1 - d0)) END, 6) AS bridged, rate IS NULL AS illustrative FROM z""")
def _(fx):
    df = S.bridge_gaps(S.densify(contacts(fx), O), "rate", O)
    return df.select("d", "rate", F.round("bridged", 6).alias("bridged"), "illustrative")


WEEKLY = """WITH w AS (SELECT CAST(DATE_TRUNC('week', d) AS DATE) AS week, CAST(SUM(community) AS BIGINT) AS community, CAST(SUM(intra) AS BIGINT) AS intra, COUNT(*) AS days_reported
FROM fx_community_daily GROUP BY 1)
"""


def weekly(fx: Fixtures) -> DataFrame:
    return S.weekly_deltas(fx.community_daily.withColumn("outbreak", F.lit("o1")), ["community", "intra"], O)


@query("a1_weekly_deltas", WEEKLY + "SELECT week, community, intra, days_reported FROM w")
def _(fx):
    return weekly(fx).drop("outbreak")


@query("a2_weekly_share", WEEKLY + """
SELECT week, CASE WHEN community + intra > 0 THEN ROUND(100.0E0 * community / (community + intra), 1) ELSE 0.0E0 END AS community_share,
  CASE WHEN community + intra > 0 THEN ROUND(100.0E0 * intra / (community + intra), 1) ELSE 0.0E0 END AS intra_share FROM w
UNION ALL SELECT DATE '2023-12-25', 50.6E0, 49.4E0""")
def _(fx):
    published = fx.spark.sql("SELECT 'o1' AS outbreak, DATE '2023-12-25' AS week, 50.6D AS community_share, 49.4D AS intra_share")
    return S.weekly_share(weekly(fx), ["community", "intra"], published).select("week", "community_share", "intra_share")


@query("a5_cfr", """
SELECT province, zone, d, CASE WHEN cases > 0 THEN ROUND(100.0E0 * deaths / cases, 1) ELSE 0.0E0 END AS cfr FROM fx_zone_history""")
def _(fx):
    return fx.zone_history.select("province", "zone", "d", S.cfr(F.col("deaths"), F.col("cases"), 0.0).alias("cfr"))


@query("a15_series_range", "SELECT province, COUNT(*) AS reports, MIN(d) AS first_date, MAX(d) AS last_date FROM fx_province_history GROUP BY province")
def _(fx):
    return S.series_range(fx.province_history, ["province"])


STEPS = [10, 50, 100, 500, 1000, 5000]


@query("w9_crossings", f"""
SELECT province, CAST(step AS BIGINT) AS step, MIN(d) AS d FROM fx_province_history, (SELECT UNNEST({STEPS}) AS step) s WHERE confirmed >= step GROUP BY province, step""")
def _(fx):
    return S.crossings(fx.province_history, "confirmed", STEPS, ["province"])


@query("w10_arrivals", """
WITH f AS (SELECT province, MIN(d) AS d FROM fx_province_history WHERE confirmed > 0 GROUP BY province),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY d, province) AS n FROM f) SELECT province, d FROM r WHERE n > 1""")
def _(fx):
    return S.arrivals(fx.province_history.withColumn("outbreak", F.lit("o1")), "province", "confirmed", O).select("province", "d")


@query("w11_case_window", """
WITH r AS (SELECT province, zone, d, cases, cases > COALESCE(LAG(cases) OVER (PARTITION BY province, zone ORDER BY d), 0) AS rise FROM fx_zone_history)
SELECT province, zone, MIN(CASE WHEN cases > 0 THEN d END) AS first_case, MAX(CASE WHEN rise THEN d END) AS last_case FROM r GROUP BY province, zone""")
def _(fx):
    return S.case_window(fx.zone_history, "cases", ["province", "zone"])


@query("w12_rank_entities", """
WITH t AS (SELECT province, MAX(confirmed) AS confirmed FROM fx_province_history GROUP BY province)
SELECT province, confirmed, CAST(ROW_NUMBER() OVER (ORDER BY confirmed DESC, province) AS INT) AS rank FROM t""")
def _(fx):
    top = fx.province_history.groupBy("province").agg(F.max("confirmed").alias("confirmed")).withColumn("outbreak", F.lit("o1"))
    return S.rank_entities(top, "province", "confirmed", O).drop("outbreak")


@query("w13_status_replay", """
WITH r AS (SELECT province, zone, d, deaths > COALESCE(LAG(deaths) OVER w, 0) AS rise FROM fx_zone_history WINDOW w AS (PARTITION BY province, zone ORDER BY d)),
s AS (SELECT province, zone, d, MAX(CASE WHEN rise THEN d END) OVER (PARTITION BY province, zone ORDER BY d) AS l FROM r)
SELECT province, zone, d, CAST(d - l AS INT) AS days_no_case, CASE WHEN d = l THEN 'active' WHEN d - l >= 42 THEN 'inactive' ELSE 'quiet' END AS status FROM s""")
def _(fx):
    return S.status_replay(fx.zone_history, "deaths", ["province", "zone"], inactive_after=42).select("province", "zone", "d", "days_no_case", "status")


@query("w13_advance_status", """
WITH p AS (SELECT c_custkey AS zone, CASE c_custkey % 3 WHEN 0 THEN 'epicentre' WHEN 1 THEN 'active' END AS status, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 90 AS INT) END AS days_no_case FROM customer WHERE c_custkey % 5 <> 4),
t AS (SELECT c_custkey AS zone, CASE WHEN c_custkey % 4 = 0 THEN CAST(1 AS BIGINT) WHEN c_custkey % 4 = 1 THEN CAST(0 AS BIGINT) END AS new_cases FROM customer)
SELECT t.zone, CASE WHEN COALESCE(new_cases, 0) > 0 AND status = 'epicentre' THEN 'epicentre' WHEN COALESCE(new_cases, 0) > 0 OR status IS NULL THEN 'active' ELSE status END AS status,
 CASE WHEN COALESCE(new_cases, 0) > 0 THEN NULL ELSE days_no_case + 1 END AS days_no_case FROM t LEFT JOIN p ON t.zone = p.zone""")
def _(fx):
    prev = fx.sql("SELECT c_custkey AS zone, CASE c_custkey % 3 WHEN 0 THEN 'epicentre' WHEN 1 THEN 'active' END AS status, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 90 AS INT) END AS days_no_case FROM customer WHERE c_custkey % 5 <> 4")
    today = fx.sql("SELECT c_custkey AS zone, CASE WHEN c_custkey % 4 = 0 THEN CAST(1 AS BIGINT) WHEN c_custkey % 4 = 1 THEN CAST(0 AS BIGINT) END AS new_cases FROM customer")
    return S.advance_status(prev, today, "zone")


SIDE = "SELECT province, MAX(d) + INTERVAL 1 DAY * CAST(LENGTH(province) % 3 - 1 AS INT) AS d, MAX(confirmed) + 5 AS confirmed FROM fx_province_history GROUP BY province"


def side(fx: Fixtures) -> DataFrame:
    last = fx.province_history.groupBy("province").agg(F.max("d").alias("m"), F.max("confirmed").alias("c"))
    return last.select("province", F.date_add("m", F.length("province") % 3 - 1).alias("d"), (F.col("c") + 5).alias("confirmed"))


@query("w14_effective_headline", f"""
WITH s AS (SELECT province, CAST(d AS DATE) AS d, confirmed FROM ({SIDE}) q),
p AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY province ORDER BY d DESC) AS n FROM fx_province_history) q WHERE n = 1)
SELECT p.province, CASE WHEN s.d > p.d THEN s.d ELSE p.d END AS d, CASE WHEN s.d > p.d THEN s.confirmed ELSE p.confirmed END AS confirmed, NOT s.d > p.d AS is_primary
FROM p JOIN s ON p.province = s.province""")
def _(fx):
    return S.effective_headline(fx.province_history, side(fx), ["province"])


@query("w15_append_if_newer", f"""
WITH s AS (SELECT province, CAST(d AS DATE) AS d, confirmed FROM ({SIDE}) q), m AS (SELECT province, MAX(d) AS l FROM fx_province_history GROUP BY province)
SELECT province, d, confirmed FROM fx_province_history UNION ALL SELECT s.province, s.d, s.confirmed FROM s JOIN m ON s.province = m.province WHERE s.d > m.l""")
def _(fx):
    return S.append_if_newer(fx.province_history, side(fx), ["province"])


NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("w16_series_by_entity", "SELECT d, " + ", ".join(f"MAX(CASE WHEN province = '{n}' THEN confirmed END) AS \"{n}\"" for n in NAMES) + " FROM fx_province_history GROUP BY d")
def _(fx):
    return S.series_by_entity(fx.province_history, "province", "confirmed", NAMES, [])


@query("w17_toll_share", """
SELECT province, d, confirmed, LEAST(100.0E0, ROUND(100.0E0 * confirmed / MAX(confirmed) OVER (PARTITION BY province), 1)) AS share FROM fx_province_history""")
def _(fx):
    return S.toll_share(fx.province_history, "confirmed", ["province"])
