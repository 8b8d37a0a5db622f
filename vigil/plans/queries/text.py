"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.operators import geo as G
from vigil.plans.registry import query


@query("f1_norm_int", r"""
SELECT doc_date, zone, TRY_CAST(NULLIF(regexp_replace(line, '[^0-9]', '', 'g'), '') AS BIGINT) AS n,
  CASE WHEN UPPER(TRIM(cell)) IN ('NA', 'ND') THEN NULL ELSE TRY_CAST(NULLIF(regexp_replace(cell, '[^0-9]', '', 'g'), '') AS BIGINT) END AS cell
FROM (SELECT doc_date, zone, line, CASE WHEN DAY(doc_date) % 3 = 0 THEN 'nd ' ELSE regexp_extract(line, ' ([0-9]+) ', 1) END AS cell FROM fx_bulletin_lines) t""")
def _(fx):
    cell = F.when(F.dayofmonth("doc_date") % 3 == 0, "nd ").otherwise(F.regexp_extract("line", " ([0-9]+) ", 1))
    return fx.bulletin_lines.select("doc_date", "zone", T.norm_int(F.col("line")).alias("n"), T.norm_int(cell).alias("cell"))


@query("f2_norm_pct", r"""
SELECT doc_date, zone, COALESCE(TRY_CAST(NULLIF(replace(regexp_extract(line, '(\d+)[.,](\d+)', 0), ',', '.'), '') AS DOUBLE),
  TRY_CAST(NULLIF(regexp_extract(line, '(\d+)\s*%', 1), '') AS DOUBLE)) AS pct FROM fx_bulletin_lines""")
def _(fx):
    return fx.bulletin_lines.select("doc_date", "zone", T.norm_pct(F.col("line")).alias("pct"))


@query("f3_strip_accents", "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


LABELS = "SELECT d, d + INTERVAL 6 DAY AS e FROM fx_contacts"


@query("f4_month_number", """
SELECT d, CAST(MONTH(d) AS INT) AS month FROM fx_sitreps""")
def _(fx):
    names = F.array(*(F.lit(m) for m in ("Janvier", "Février", "mars", "AVRIL", "mai", "juin ", "Juillet", "Août", "Septembre", "octobre", "novembre", "décembre")))
    return fx.sitreps.select("d", T.month_number(F.element_at(names, F.month("d"))).alias("month"))


@query("f5_zone_key_upper", r"""
SELECT c_custkey, spelled, upper(regexp_replace(trim(regexp_replace(trim(spelled), '\*+$', '')), '[-\s]+', ' ', 'g')) AS key FROM fx_customer_name""")
def _(fx):
    return fx.customer_name.select("c_custkey", "spelled", T.zone_key_upper(F.col("spelled")).alias("key"))


@query("f6_zone_key_tight", r"""
SELECT c_custkey, spelled, replace(trim(regexp_replace(strip_accents(lower(spelled)), '[^a-z0-9]+', ' ', 'g')), ' ', '') AS tight,
  trim(regexp_replace(strip_accents(lower(spelled)), '[^a-z0-9]+', ' ', 'g')) AS loose FROM fx_customer_name""")
def _(fx):
    c = F.col("spelled")
    return fx.customer_name.select("c_custkey", "spelled", T.zone_key_tight(c).alias("tight"), T.zone_key_tight(c, tight=False).alias("loose"))


@query("f7_zone_key_lower", r"SELECT c_custkey, spelled, regexp_replace(lower(trim(spelled)), '[\s-]+', ' ', 'g') AS key FROM fx_customer_name")
def _(fx):
    return fx.customer_name.select("c_custkey", "spelled", T.zone_key_lower(F.col("spelled")).alias("key"))


FILES = "SELECT doc_id, 'reports/SitRep_' || lpad(CAST(doc_id AS VARCHAR), 3, '0') || CASE doc_id % 4 WHEN 1 THEN '_bis' WHEN 2 THEN '-TER' WHEN 3 THEN 'x' ELSE '' END || '.pdf' AS name FROM documents"


def file_names(fx):
    suffix = F.when(F.col("doc_id") % 4 == 1, "_bis").when(F.col("doc_id") % 4 == 2, "-TER").when(F.col("doc_id") % 4 == 3, "x").otherwise("")
    return fx.table("documents").select("doc_id", F.concat(F.lit("reports/SitRep_"), F.lpad(F.col("doc_id").cast("string"), 3, "0"), suffix, F.lit(".pdf")).alias("name"))


@query("f8_report_id", rf"""
SELECT name, regexp_extract(lower(name), '(\d{{3}})[-_]?(bis|ter|quater)?', 1) || CASE WHEN regexp_extract(lower(name), '(\d{{3}})[-_]?(bis|ter|quater)?', 2) <> ''
  THEN '-' || regexp_extract(lower(name), '(\d{{3}})[-_]?(bis|ter|quater)?', 2) ELSE '' END AS id FROM ({FILES}) f""")
def _(fx):
    return file_names(fx).select("name", T.report_id(F.col("name")).alias("id"))


@query("f9_rate_class", """
SELECT province, zone, d, CASE WHEN r IS NULL OR r < 30 THEN 'low' WHEN r < 50 THEN 'mid' ELSE 'high' END AS class
FROM (SELECT province, zone, d, CASE WHEN cases % 7 <> 0 THEN 100.0E0 * deaths / cases END AS r FROM fx_zone_history) t""")
def _(fx):
    rate = F.when(F.col("cases") % 7 != 0, 100.0 * F.col("deaths") / F.col("cases"))
    return fx.zone_history.select("province", "zone", "d", T.rate_class(rate).alias("class"))


@query("f10_intensity_level", """
SELECT province, zone, d, CASE WHEN deaths <= 0 THEN 0 WHEN deaths < 10 THEN 1 WHEN deaths < 50 THEN 2 WHEN deaths < 200 THEN 3 ELSE 4 END AS level FROM fx_zone_history""")
def _(fx):
    return fx.zone_history.select("province", "zone", "d", T.intensity_level(F.col("deaths")).alias("level"))


@query("f11_fmt_int", """
SELECT d, COALESCE(format('{:,}', deaths), '—') AS en, COALESCE(replace(format('{:,}', deaths), ',', chr(8239)), '—') AS fr,
  CASE WHEN deaths IS NULL THEN '—' ELSE replace(printf('%.1f', ROUND(deaths / 8.0E0, 1)), '.', ',') END AS decimal FROM fx_sitreps""")
def _(fx):
    c = F.col("deaths")
    return fx.sitreps.select("d", T.fmt_int(c).alias("en"), T.fmt_int(c, "fr").alias("fr"), T.fmt_decimal(c / 8, "fr").alias("decimal"))


@query("f12_date_label", """
SELECT d, CAST(DAY(d) AS VARCHAR) || ' ' || strftime(d, '%b') AS short, CAST(DAY(d) AS VARCHAR) || ' ' || strftime(d, '%b') || ' ' || CAST(YEAR(d) AS VARCHAR) AS long,
  strftime(d, '%d/%m') || '–' || strftime(d + INTERVAL 6 DAY, '%d/%m') AS week FROM fx_sitreps""")
def _(fx):
    c = F.col("d")
    return fx.sitreps.select("d", *(T.date_label(c, "en", s).alias(s) for s in ("short", "long", "week")))


@query("f13_ordinal", """
SELECT doc_id, CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN doc_id % 10 = 1 THEN 'st' WHEN doc_id % 10 = 2 THEN 'nd' WHEN doc_id % 10 = 3 THEN 'rd' ELSE 'th' END AS en,
  CASE WHEN doc_id = 1 THEN '1re' ELSE CAST(doc_id AS VARCHAR) || 'ᵉ' END AS fr FROM documents""")
def _(fx):
    c = F.col("doc_id")
    return fx.table("documents").select("doc_id", T.ordinal(c).alias("en"), T.ordinal(c, "fr").alias("fr"))


@query("f14_interpolate", """
SELECT province, d, province || ': ' || CAST(confirmed AS VARCHAR) || ' case' || CASE WHEN confirmed = 1 THEN '' ELSE 's' END || ' {other}' AS label FROM fx_province_history""")
def _(fx):
    template = F.lit("{province}: {n} case{n?s} {other}")
    return fx.province_history.select("province", "d", T.interpolate(template, {"province": F.col("province"), "n": F.col("confirmed")}).alias("label"))


@query("f15_haversine", """
SELECT a.point_id AS a, b.point_id AS b, ROUND(2 * 6371.0E0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (
 SELECT *, 0 AS z FROM fx_points) a JOIN fx_points b ON a.zone_id = b.zone_id AND a.point_id < b.point_id,
 LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h) x""")
def _(fx):
    km = T.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    pairs = G.pairs_within(fx.points, "zone_id", "point_id")
    return pairs.select(F.col("a.point_id").alias("a"), F.col("b.point_id").alias("b"), F.round(km, 6).alias("km"))


@query("f16_in_box", "SELECT point_id, lat BETWEEN -5.0E0 AND 3.0E0 AND lon BETWEEN 15.0E0 AND 30.0E0 AS inside FROM fx_points")
def _(fx):
    return fx.points.select("point_id", T.in_box(F.col("lat"), F.col("lon"), (-5.0, 15.0, 3.0, 30.0)).alias("inside"))


@query("f17_iso_date", """
SELECT d, TRY_CAST(printf('%04d-%02d-%02d', YEAR(d), MONTH(d), DAY(d) + 3) AS DATE) AS later FROM fx_sitreps""")
def _(fx):
    return fx.sitreps.select("d", T.iso_date(F.year("d"), F.month("d"), F.dayofmonth("d") + 3).alias("later"))


@query("x31_is_placeholder", """
SELECT c_custkey, label, upper(label) LIKE '%AUTRES ZONE%' OR upper(label) LIKE '%NON IDENTIFI_E%' OR upper(label) LIKE '%NON PR_CIS_E%' OR label IN ('Karissibi', 'Kilo Mission') AS placeholder
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Autres zones' WHEN 1 THEN spelled || ' (zone non précisée)' WHEN 2 THEN 'Kilo Mission' WHEN 3 THEN 'zones non identifiées' ELSE spelled END AS label FROM fx_customer_name) t""")
def _(fx):
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, "Autres zones").when(k == 1, F.concat("spelled", F.lit(" (zone non précisée)"))).when(k == 2, "Kilo Mission").when(k == 3, "zones non identifiées").otherwise(F.col("spelled"))
    return fx.customer_name.select("c_custkey", label.alias("label")).withColumn("placeholder", T.is_placeholder(F.col("label")))


@query("x32_is_non_zone", r"""
SELECT doc_date, line_no, regexp_matches(upper(trim(l)), '^(A VENTILER|TOTAL|AUTRES ZONES)') AS non_zone
FROM (SELECT doc_date, line_no, CASE WHEN line_no = 1 THEN 'Total general' WHEN line_no = 2 THEN ' a ventiler 3' ELSE line END AS l FROM fx_report_lines) t""")
def _(fx):
    line = F.when(F.col("line_no") == 1, "Total general").when(F.col("line_no") == 2, " a ventiler 3").otherwise(F.col("line"))
    return fx.report_lines.select("doc_date", "line_no", T.is_non_zone(line).alias("non_zone"))
