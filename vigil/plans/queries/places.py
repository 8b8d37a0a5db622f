"""Queries of geography, catalogs and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions.session import shared_dir
from vigil.operators import geo as G
from vigil.operators import match as M
from vigil.plans.registry import query
from vigil.sources import catalog as C
from vigil.streaming import ingest as I


def scratch(fx, name):
    """A new place in the shared folder."""
    return f"{shared_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


R = "ROUND({0}, 6) AS {1}"
BOX = "SELECT zone_id, MIN(lon) AS x0, MIN(lat) AS y0, MAX(lon) AS x1, MAX(lat) AS y1 FROM fx_ring GROUP BY zone_id"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("a14_boxes", f"SELECT zone_id, ROUND(x0, 6) AS x0, ROUND(y0, 6) AS y0, ROUND(x1, 6) AS x1, ROUND(y1, 6) AS y1, ROUND(x1 - x0, 6) AS w, ROUND(y1 - y0, 6) AS h FROM ({BOX}) b")
def _(fx):
    return rounded(G.boxes(fx.ring, ["zone_id"]), "x0", "y0", "x1", "y1", "w", "h")


EXTENT = "SELECT LEAST(a, e - 0.4E0) AS x0, LEAST(b, f - 0.4E0) AS y0, GREATEST(c, g + 0.4E0) AS x1, GREATEST(d, h + 0.4E0) AS y1 FROM (SELECT MIN(lon) AS a, MIN(lat) AS b, MAX(lon) AS c, MAX(lat) AS d FROM fx_ring) v, (SELECT MIN(lon) AS e, MIN(lat) AS f, MAX(lon) AS g, MAX(lat) AS h FROM fx_points) p"


@query("g1_extent", f"SELECT ROUND(x0, 6) AS x0, ROUND(y0, 6) AS y0, ROUND(x1, 6) AS x1, ROUND(y1, 6) AS y1 FROM ({EXTENT}) e")
def _(fx):
    return rounded(G.extent(fx.ring, fx.points), "x0", "y0", "x1", "y1")


@query("g2_project", f"SELECT point_id, ROUND((lon - x0) * (1000.0E0 / (x1 - x0)), 1) AS x, ROUND((y1 - lat) * (1000.0E0 / (x1 - x0)), 1) AS y FROM fx_points, ({EXTENT}) e")
def _(fx):
    return G.project(fx.points, G.extent(fx.ring, fx.points)).select("point_id", "x", "y")


FRAMES = f"SELECT r_name AS province, MIN(x0) - 0.14E0 * (MAX(x1) - MIN(x0)) AS x0, MIN(y0) - 0.14E0 * (MAX(y1) - MIN(y0)) AS y0, MAX(x1) + 0.14E0 * (MAX(x1) - MIN(x0)) AS x1, MAX(y1) + 0.14E0 * (MAX(y1) - MIN(y0)) AS y1 FROM ({BOX}) b JOIN nation ON n_nationkey = zone_id JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def zones(fx):
    return fx.sql("SELECT n_nationkey AS zone_id, n_name AS zone, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey")


def frames(fx):
    return G.province_frames(G.boxes(fx.ring, ["zone_id"]).join(zones(fx), "zone_id"), "province")


@query("g3_province_frames", f"SELECT province, ROUND(x0, 6) AS x0, ROUND(y0, 6) AS y0, ROUND(x1, 6) AS x1, ROUND(y1, 6) AS y1 FROM ({FRAMES}) f")
def _(fx):
    return rounded(frames(fx), "x0", "y0", "x1", "y1")


AWAY = "CASE WHEN n > 0 THEN ABS(dx * py - dy * px) / n ELSE sqrt(px * px + py * py) END"
SPLITS = f"""
WITH RECURSIVE t AS (SELECT zone_id, part, CASE WHEN zone_id % 2 = 0 THEN 0.05E0 ELSE 0.02E0 END / part AS tol FROM (SELECT DISTINCT zone_id FROM fx_ring) z, (VALUES (1), (4), (16)) AS p(part)),
seg AS (SELECT t.zone_id, part, tol, MIN(seq) AS a, MAX(seq) AS b FROM t JOIN fx_ring v ON v.zone_id = t.zone_id GROUP BY t.zone_id, part, tol
  UNION ALL
  SELECT zone_id, part, tol, UNNEST([a, m]) AS a, UNNEST([m, b]) AS b FROM (
    SELECT zone_id, part, tol, a, b, arg_max(seq, struct_pack(d := d, s := -seq)) AS m FROM (
      SELECT zone_id, part, tol, a, b, seq, {AWAY} AS d FROM (
        SELECT *, sqrt(dx * dx + dy * dy) AS n FROM (
          SELECT seg.zone_id, part, tol, a, b, v.seq, e.lon - s.lon AS dx, e.lat - s.lat AS dy, v.lon - s.lon AS px, v.lat - s.lat AS py
          FROM seg JOIN fx_ring s ON s.zone_id = seg.zone_id AND s.seq = a JOIN fx_ring e ON e.zone_id = seg.zone_id AND e.seq = b
          JOIN fx_ring v ON v.zone_id = seg.zone_id AND v.seq > a AND v.seq < b) q) q2) q3
    WHERE d > tol GROUP BY zone_id, part, tol, a, b) far),
kept AS (SELECT DISTINCT zone_id, part, UNNEST([a, b]) AS seq FROM seg),
fine AS (SELECT zone_id, MIN(part) AS part FROM (SELECT zone_id, part, COUNT(*) AS n FROM kept GROUP BY zone_id, part) c WHERE n >= 4 GROUP BY zone_id)
SELECT v.zone_id, v.ring_no, v.seq, v.lon, v.lat FROM fx_ring v JOIN fine f ON f.zone_id = v.zone_id JOIN kept k ON k.zone_id = v.zone_id AND k.part = f.part AND k.seq = v.seq
UNION ALL SELECT zone_id, ring_no, seq, lon, lat FROM fx_ring WHERE zone_id NOT IN (SELECT zone_id FROM fine)"""


@query("g4_simplify_rings", SPLITS)
def _(fx):
    return G.simplify_rings(fx.ring, F.when(F.col("zone_id") % 2 == 0, 0.05).otherwise(0.02))


@query("g5_ring_paths", f"""
SELECT zone_id, 'M ' || string_agg(printf('%.1f %.1f', ROUND((lon - x0) * (1000.0E0 / (x1 - x0)), 1), ROUND((y1 - lat) * (1000.0E0 / (x1 - x0)), 1)), ' L ' ORDER BY seq) || ' Z' AS path FROM fx_ring, ({EXTENT}) e GROUP BY zone_id""")
def _(fx):
    return G.ring_paths(G.project(fx.ring, G.extent(fx.ring, fx.points)), ["zone_id"])


@query("g6_audit_coordinates", """
SELECT point_id, ROUND(km, 6) AS km, km > 15 AS moved, lat + 0.1 * (point_id % 4) BETWEEN -13.459E0 AND 5.386E0 AND lon BETWEEN 12.204E0 AND 33.2E0 AS in_country, point_id % 5 <> 0 AS same_province
FROM (SELECT *, 2 * 6371.0E0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (SELECT *, pow(sin(radians((lat + 0.1 * (point_id % 4)) - lat) / 2), 2) AS h FROM fx_points) a) b""")
def _(fx):
    p = fx.points.withColumn("province", F.lit("p"))
    n = p.withColumns({"lat": F.col("lat") + 0.1 * (F.col("point_id") % 4), "province": F.when(F.col("point_id") % 5 == 0, "q").otherwise("p")})
    return G.audit_coordinates(p, n, "point_id", (-13.459, 12.204, 5.386, 33.2))


@query("g7_unmatched_zones", "SELECT zone_id, c_custkey, zone, province FROM fx_customer_name WHERE zone_id NOT IN (SELECT zone_id FROM fx_ring WHERE seq % 40 = 0)")
def _(fx):
    ours = fx.customer_name.select("zone_id", "c_custkey", "zone", "province")
    return G.unmatched_zones(ours, fx.ring.where("seq % 40 = 0"), "zone_id")


@query("g8_within_search_frame", f"""
SELECT point_id, lon BETWEEN x0 - 0.3E0 AND x1 + 0.3E0 AND lat BETWEEN y0 - 0.3E0 AND y1 + 0.3E0 AS inside FROM fx_points JOIN nation ON n_nationkey = zone_id JOIN region ON r_regionkey = n_regionkey JOIN ({FRAMES}) f ON f.province = r_name""")
def _(fx):
    return G.within_search_frame(fx.points.join(zones(fx), "zone_id"), frames(fx), "province").select("point_id", "inside")


@query("g9_name_column_vote", "SELECT 'zone' AS \"column\", COUNT(DISTINCT zone) AS hits FROM fx_customer_name")
def _(fx):
    return G.name_column_vote(fx.customer_name, zones(fx), ["zone", "c_custkey", "spelled"], "zone")


@query("j12_frame_zones", f"""
SELECT f.province AS frame, b.zone_id, b.x0 >= f.x0 AND b.x1 <= f.x1 AND b.y0 >= f.y0 AND b.y1 <= f.y1 AS inside FROM ({BOX}) b JOIN ({FRAMES}) f ON b.x1 >= f.x0 AND b.x0 <= f.x1 AND b.y1 >= f.y0 AND b.y0 <= f.y1""")
def _(fx):
    return M.frame_zones(G.boxes(fx.ring, ["zone_id"]), frames(fx).withColumnRenamed("province", "frame"))


@query("j13_frame_landmarks", f"""
SELECT f.province AS frame, p.point_id FROM (SELECT point_id, lon, lat, CASE WHEN point_id % 3 <> 0 THEN r_name END AS province FROM fx_points JOIN nation ON n_nationkey = zone_id JOIN region ON n_regionkey = r_regionkey) p
JOIN ({FRAMES}) f ON p.lon BETWEEN f.x0 AND f.x1 AND p.lat BETWEEN f.y0 AND f.y1 AND (p.province IS NULL OR p.province = f.province)""")
def _(fx):
    p = fx.points.join(zones(fx), "zone_id").withColumn("province", F.when(F.col("point_id") % 3 != 0, F.col("province")))
    return M.frame_landmarks(p, frames(fx).withColumnRenamed("province", "frame"))


@query("s10_to_features", """
SELECT zone_id, '{"type":"Feature","properties":{"zone":"' || zone || '","province":"' || province || '"},"geometry":{"type":"Polygon","coordinates":[[' || ring || ']]}}' AS feature
FROM (SELECT zone_id, string_agg('[' || CAST(ROUND(lon, 4) AS VARCHAR) || ',' || CAST(ROUND(lat, 4) AS VARCHAR) || ']', ',' ORDER BY seq) AS ring FROM fx_ring GROUP BY zone_id) v
JOIN (SELECT n_nationkey, n_name AS zone, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey) z ON n_nationkey = zone_id""")
def _(fx):
    return G.to_features(zones(fx), fx.ring.withColumns({"lon": F.round("lon", 4), "lat": F.round("lat", 4)}))


@query("s1_read_history", "SELECT d AS date, confirmed, deaths, recovered FROM fx_sitreps")
def _(fx):
    path = scratch(fx, "history")
    rows = fx.sitreps.select(F.col("d").alias("date"), "confirmed", "deaths", "recovered").unionByName(fx.spark.sql("SELECT CAST(NULL AS DATE) AS date, 1L AS confirmed, 2L AS deaths, 3L AS recovered"))
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none"))
    rows.groupBy(month.alias("m")).agg(F.to_json(F.collect_list(F.struct("date", "confirmed", "deaths", "recovered"))).alias("value")).repartition("m").write.partitionBy("m").text(path)  # a file is one array
    return C.read_history(fx.spark, path, C.SCHEMAS["sitreps"]).drop("approx", "m")


def paths(fx):
    k = F.col("page_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("who_"), k.cast("string"), F.lit("_2026-0"), (k % 12).cast("string"), F.lit("-11.pdf"))).when(k % 4 == 1, F.concat(F.lit("SitRep_"), F.lpad(k.cast("string"), 3, "0"), F.lit("-bis.pdf"))).when(k % 4 == 2, F.concat(F.lit("SitRep_"), F.lpad(k.cast("string"), 3, "0"), F.lit(".pdf"))).otherwise("notes.txt")
    return fx.table("pages").select("page_id", F.concat(F.lit("reports/2026/"), name).alias("path"))


PATHS = "SELECT page_id, 'reports/2026/' || CASE page_id % 4 WHEN 0 THEN 'who_' || CAST(page_id AS VARCHAR) || '_2026-0' || CAST(page_id % 12 AS VARCHAR) || '-11.pdf' WHEN 1 THEN 'SitRep_' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '-bis.pdf' WHEN 2 THEN 'SitRep_' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '.pdf' ELSE 'notes.txt' END AS path FROM pages"
FILES = rf"SELECT page_id, path, regexp_extract(lower(regexp_extract(path, '[^/]*$')), '(\d{{3}})[-_]?(bis)?', 1) || CASE WHEN path LIKE '%-bis%' THEN '-bis' ELSE '' END AS sitrep FROM ({PATHS}) p WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '\d{{3}}')"


@query("s3_report_files", FILES)
def _(fx):
    return C.report_files(paths(fx))


@query("s4_latest_report", f"SELECT sitrep, path FROM ({FILES}) f WHERE path LIKE '%SitRep%' ORDER BY sitrep DESC LIMIT 1")
def _(fx):
    return C.latest_report(C.report_files(paths(fx)).where(F.col("path").contains("SitRep")))


@query("s5_weekly_index", f"""
SELECT CAST(page_id AS VARCHAR) AS number, TRY_CAST('2026-0' || CAST(page_id % 12 AS VARCHAR) || '-11' AS DATE) AS date, path FROM ({PATHS}) p WHERE page_id % 4 = 0 AND page_id % 12 < 10
UNION ALL SELECT NULL, NULL, path FROM ({PATHS}) p WHERE NOT (page_id % 4 = 0 AND page_id % 12 < 10)""")
def _(fx):
    good, bad = C.weekly_index(paths(fx))
    return good.unionByName(bad, allowMissingColumns=True)


@query("s11_report_links", r"""
SELECT page_id, trim(regexp_replace(regexp_extract(a, '<a href="([^"]*)">(.*?)</a>', 2), '<[^>]*>', '', 'g')) AS title, regexp_extract(a, '<a href="([^"]*)">(.*?)</a>', 1) AS href
FROM (SELECT page_id, UNNEST(regexp_extract_all(html, '<li><a href="[^"]*">.*?</a></li>')) AS a FROM pages) t WHERE contains(lower(a), 'th') AND contains(lower(regexp_extract(a, '<a href="([^"]*)">(.*?)</a>', 2)), 'th')""")
def _(fx):
    return C.report_links(fx.table("pages"), "TH", "li")


@query("s12_embedded_doc_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '/files/' || CAST(page_id AS VARCHAR) || '.pdf' END AS url FROM pages")
def _(fx):
    token = F.regexp_replace(F.base64(F.to_json(F.struct("url")).cast("binary")), r"[\r\n=]", "")
    k = F.col("page_id")
    extra = F.when(k % 3 == 0, F.concat(F.lit("<i data='pdfemb-data=e30' pdfemb-data="), token, F.lit("></i>"))).when(k % 3 == 1, F.concat(F.lit('<a class="x" href="/files/'), k.cast("string"), F.lit('.pdf">x</a>'))).otherwise("")
    return C.embedded_doc_url(fx.table("pages").withColumn("html", F.concat("html", extra)))


@query("s13_expand_pages", "SELECT page_id, CAST(n AS INT) AS n, CASE WHEN n = 1 THEN 'c/' ELSE 'c/page/' || CAST(n AS VARCHAR) || '/' END AS url FROM (SELECT page_id, UNNEST(generate_series(1, GREATEST(1, page_id % 9))) AS n FROM pages) t")
def _(fx):
    html = F.concat("html", F.lit('<a href="/category/page/'), (F.col("page_id") % 9).cast("string"), F.lit('/">last</a>'))
    return C.expand_pages(fx.table("pages").withColumn("html", html), F.lit("c/"), r"/category/page/(\d+)")


@query("s14_fetch_backlog", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def _(fx):
    p = fx.table("pages")
    return C.fetch_backlog(p.select("url"), p.where("page_id % 3 = 0"), "url")


@query("s15_title_to_number", r"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') ELSE 'titre_' || CAST(page_id AS VARCHAR) || '_é' END AS number FROM pages""")
def _(fx):
    k = F.col("page_id")
    title = F.when(k % 2 == 0, F.concat(F.lit("SitRep N° 0"), (k % 1000).cast("string"))).otherwise(F.concat(F.lit("titre "), k.cast("string"), F.lit(" - é")))
    return fx.table("pages").select("page_id", C.title_to_number(title).alias("number"))


@query("s16_index_row", "SELECT d, CAST(d AS VARCHAR) AS sitrep, CASE WHEN DAY(d) % 6 <> 0 THEN confirmed END AS confirmed, CASE WHEN DAY(d) % 6 <> 0 THEN deaths END AS deaths, DAY(d) % 6 = 0 AS confirmed_extraction_failed FROM fx_sitreps")
def _(fx):
    s = fx.sitreps.withColumn("sitrep", F.col("d").cast("string"))
    return C.index_row(s.select("d", "sitrep"), s.where(F.dayofmonth("d") % 6 != 0))


@query("t1_ingest_stream", "SELECT province, d, MAX(confirmed) AS confirmed FROM (SELECT province, d, confirmed FROM fx_province_history UNION ALL SELECT province, d, confirmed + 1 FROM fx_province_history WHERE DAY(d) = 3) t GROUP BY province, d")
def _(fx):
    base = scratch(fx, "stream")
    rows = fx.province_history.withColumn("rev", F.lit(0)).unionByName(fx.province_history.where(F.dayofmonth("d") == 3).withColumns({"confirmed": F.col("confirmed") + 1, "rev": F.lit(1)}))
    rows.repartition(4).write.json(f"{base}/in")
    schema = "province STRING, d DATE, confirmed BIGINT, rev INT"
    I.ingest_stream(fx.spark, f"{base}/in", schema, f"{base}/history", f"{base}/seen", ["province", "d"], F.year("d"), ["rev"]).awaitTermination()
    return I.current(fx.spark, f"{base}/history", schema).drop("rev")
