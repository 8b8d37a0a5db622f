"""Views over the driver's tables in the shapes of surveillance data: one SQL text for Spark and for the oracle.

Province is a region, zone a nation, report date an order date, case an order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession



def spaced(x: str) -> str:
    """A number below a million as text, a space before its last three digits."""
    thousands = f"CONCAT(CAST(CAST(FLOOR({x} / 1000) AS BIGINT) AS VARCHAR(20)), ' ', LPAD(CAST({x} % 1000 AS VARCHAR(20)), 3, '0'))"
    return f"CASE WHEN {x} >= 1000 THEN {thousands} ELSE CAST({x} AS VARCHAR(20)) END"


VIEWS: dict[str, str] = {
    "fx_zone_day": """
SELECT r.r_name AS province, n.n_name AS zone, CAST(o.o_orderdate AS DATE) AS d,
       CAST(COUNT(*) AS BIGINT) AS new_cases,
       CAST(SUM(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS new_deaths,
       CAST(SUM(CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS new_recovered
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name, CAST(o.o_orderdate AS DATE)
""",
    "fx_zone_history": """
SELECT province, zone, d,
       CAST(SUM(new_cases)  OVER w AS BIGINT) AS cases,
       CAST(SUM(new_deaths) OVER w AS BIGINT) AS deaths
FROM fx_zone_day
WINDOW w AS (PARTITION BY province, zone ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "fx_province_history": """
SELECT province, d,
       CAST(SUM(x) OVER (PARTITION BY province ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS confirmed
FROM (SELECT province, d, SUM(new_cases) AS x FROM fx_zone_day GROUP BY province, d) t
""",
    "fx_sitreps": """
SELECT d,
       cc - CASE WHEN DAY(d) = 13 THEN 40 ELSE 0 END AS confirmed,
       CASE WHEN DAY(d) IN (7, 21) THEN NULL ELSE dd END AS deaths,
       CASE WHEN DAY(d) % 5 = 0 THEN rr ELSE NULL END AS recovered
FROM (SELECT d,
        CAST(SUM(a) OVER w AS BIGINT) AS cc, CAST(SUM(b) OVER w AS BIGINT) AS dd, CAST(SUM(e) OVER w AS BIGINT) AS rr
      FROM (SELECT d, SUM(new_cases) AS a, SUM(new_deaths) AS b, SUM(new_recovered) AS e FROM fx_zone_day GROUP BY d) t
      WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) u
""",
    "fx_community_daily": """
SELECT CAST(ts AS DATE) AS d,
       CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS community,
       CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS intra
FROM events WHERE DAY(CAST(ts AS DATE)) % 6 <> 0 GROUP BY CAST(ts AS DATE)
""",
    "fx_contacts": """
SELECT CAST(ts AS DATE) AS d,
       ROUND(100.0E0 * SUM(CASE WHEN event_type IN ('click','view','signup') THEN 1 ELSE 0 END) / COUNT(*), 1) AS rate
FROM events WHERE DAY(CAST(ts AS DATE)) NOT IN (5, 6, 7, 19) GROUP BY CAST(ts AS DATE)
""",
    "fx_bulletin_lines": f"""
SELECT d AS doc_date, province, zone,
       CONCAT(zone, CASE WHEN DAY(d) % 2 = 0 THEN '* ' ELSE ' ' END,
              CASE WHEN DAY(d) = 3 THEN 'NA NA NA' ELSE CONCAT({spaced("cases")}, ' ', {spaced("deaths")}, ' ',
                REPLACE(CAST(CAST(ROUND(1000.0E0 * deaths / cases, 0) AS BIGINT) / 10 AS VARCHAR(20)), '.', ','), '%') END, ' 3 1') AS line
FROM (SELECT province, zone, d, cases * 9 AS cases, deaths * 9 AS deaths FROM fx_zone_history) t
""",
    "fx_report_lines": """
SELECT doc_date, CAST(ROW_NUMBER() OVER (PARTITION BY doc_date ORDER BY province, kind, zone) AS INT) AS line_no, line
FROM (SELECT DISTINCT doc_date, province, 0 AS kind, '' AS zone,
             CASE WHEN DAY(doc_date) % 3 = 0 THEN CONCAT('Sous-total ', REPLACE(province, ' ', '-')) ELSE province END AS line
      FROM fx_bulletin_lines
      UNION ALL
      SELECT doc_date, province, 1 AS kind, zone, line FROM fx_bulletin_lines) t
""",
    "fx_report_cells": """
SELECT d AS doc_date, 1 AS table_no, zone AS row_key, province, col_no,
       CASE col_no WHEN 0 THEN zone
                   WHEN 1 THEN CASE WHEN DAY(d) % 4 = 0 THEN '' END
                   WHEN 2 THEN CAST(new_deaths AS VARCHAR(20))
                   WHEN 3 THEN CASE WHEN DAY(d) % 4 = 1 THEN '' END
                   WHEN 4 THEN CAST(new_cases - new_deaths AS VARCHAR(20))
                   ELSE CAST(new_cases + CASE WHEN DAY(d) = 11 THEN 1 ELSE 0 END AS VARCHAR(20)) END AS cell
FROM fx_zone_day CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS c(col_no)
""",
    "fx_report_words": """
SELECT d AS doc_date, 1 AS page_no, x0, 260.0E0 AS top, CASE WHEN DAY(d) = 9 THEN 8.0E0 ELSE 12.0E0 END AS height, text
FROM (SELECT d, 70.0E0 AS x0, CAST(CAST(FLOOR(confirmed / 1000) AS BIGINT) AS VARCHAR(20)) AS text FROM fx_sitreps WHERE confirmed >= 1000
      UNION ALL SELECT d, 95.0E0, LPAD(CAST(confirmed % 1000 AS VARCHAR(20)), 3, '0') FROM fx_sitreps WHERE confirmed >= 1000
      UNION ALL SELECT d, 80.0E0, CAST(confirmed AS VARCHAR(20)) FROM fx_sitreps WHERE confirmed BETWEEN 0 AND 999
      UNION ALL SELECT d, 170.0E0, CAST(deaths AS VARCHAR(20)) FROM fx_sitreps WHERE deaths IS NOT NULL
      UNION ALL SELECT d, 420.0E0, CAST(recovered AS VARCHAR(20)) FROM fx_sitreps WHERE recovered IS NOT NULL) t
""",
    "fx_customer_name": """
SELECT c_custkey, n_nationkey AS zone_id, n_name AS zone, r_name AS province,
       CASE c_custkey % 4 WHEN 0 THEN CONCAT(LOWER(n_name), '*')
                          WHEN 1 THEN CONCAT(REPLACE(n_name, '_', '-'), ' bis')
                          WHEN 2 THEN REPLACE(n_name, 'TION', 'TON')
                          ELSE CONCAT('Other ', n_name, ' area') END AS spelled
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "fx_zone_alias": """
SELECT DISTINCT zone, province, spelled FROM fx_customer_name
""",
    "fx_zone_name": """
SELECT DISTINCT zone, province FROM fx_customer_name
""",
    "fx_points": """
SELECT s_suppkey AS point_id, s_nationkey AS zone_id,
       12.204E0 + (s_suppkey * 37 % 2100) / 100.0E0 AS lon,
       -13.459E0 + (s_suppkey * 53 % 1880) / 100.0E0 AS lat
FROM supplier
""",
    "fx_ring": """
SELECT n_nationkey AS zone_id, 0 AS ring_no, CAST(s_suppkey AS INT) AS seq,
       12.204E0 + n_nationkey * 0.8E0 + (s_suppkey * 37 % 101) * 0.005E0 AS lon,
       -13.459E0 + (s_suppkey * 53 % 97) * 0.002E0 AS lat
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def needed(sql: str) -> list[str]:
    """The views that a text names, those that these name first."""
    found: list[str] = []
    for view, body in VIEWS.items():
        if re.search(rf"\b{view}\b", sql):
            found += [v for v in [*needed(body), view] if v not in found]
    return found


def with_views(sql: str) -> str:
    """The text behind the definitions of the views it names."""
    names = needed(sql)
    if not names:
        return sql
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in names)
    begin = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {begin[1] or ''}{head},\n{sql[begin.end():]}" if begin else f"WITH {head}\n{sql}"


class Fixtures:
    """The views and tables of one folder as DataFrames: fx.sitreps is fx_sitreps, fx.table("orders") a table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", full)}
        bound = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(used or ["-"]) + r")\b", r"\1 {\2}", full)
        return self.spark.sql(bound, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM fx_{name}")
