"""Histories, report files and crawled listings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import report_id

# Key names of the JSON files that are read.
SCHEMAS = {
    "sitreps": "date DATE, confirmed BIGINT, deaths BIGINT, recovered BIGINT, approx BOOLEAN",
    "province_history": "date DATE, provinces ARRAY<STRUCT<name STRING, confirmed BIGINT>>",
    "zones_history": "sitrep STRING, date DATE, zones ARRAY<STRUCT<name STRING, province STRING, cases BIGINT, deaths BIGINT>>",
    "community_daily": "sitrep STRING, date DATE, provinces MAP<STRING, STRUCT<communityDeaths BIGINT, intraCteDeaths BIGINT, totalDeaths BIGINT>>, nationalCommunityDeaths BIGINT, nationalIntraCteDeaths BIGINT, nationalTotalDeaths BIGINT",
    "contacts_followup": "date DATE, sitrepNumber STRING, contactsFollowUpRate DOUBLE, source STRING",
    "social_updates": "date DATE, source STRING, url STRING, confirmed BIGINT, deaths BIGINT, recovered BIGINT, inCTE BIGINT, healthZonesAffected BIGINT, provincesAffected BIGINT",
    "who_reports": "number STRING, date DATE, file STRING",
    "reports": "sitrepNumber STRING, reportingDate DATE, publicationDate DATE, file STRING, confirmed BIGINT, deaths BIGINT, sourceNumberMismatch STRING, confirmedExtractionFailed BOOLEAN",
}


def read_history(spark: SparkSession, path: str, schema: str, date: str = "date") -> DataFrame:
    """Rows of JSON arrays that have a date; sort them at output."""
    return spark.read.schema(schema).option("multiLine", True).json(path).where(F.col(date).isNotNull())


def long_provinces(history: DataFrame) -> DataFrame:
    """(date, name, confirmed) of nested province histories."""
    return history.select("date", F.inline("provinces"))


def long_community(history: DataFrame) -> DataFrame:
    """(sitrep, date, province, counts) of community deaths kept as a map by province."""
    return history.select("sitrep", "date", F.explode("provinces").alias("province", "_v")).select("sitrep", "date", "province", "_v.*")


def report_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds `sitrep` from the file's name; files without an id are dropped."""
    name = F.element_at(F.split(path, "/"), -1)
    return paths.withColumn("sitrep", report_id(name)).where(F.col("sitrep").isNotNull())


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path) of files that match; contents are not read."""
    return spark.read.format("binaryFile").load(glob).select("path")


def latest_report(files: DataFrame) -> DataFrame:
    """One row: the greatest id by text and its path."""
    return files.agg(F.max("sitrep").alias("sitrep"), F.max_by("path", "sitrep").alias("path"))


def weekly_index(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """((number, date, path), rejected paths): the last two parts of a name, between underscores, are a number and a day."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.when(name.endswith(".pdf"), F.substring(name, F.lit(1), F.length(name) - 4)), "_")
    number, day = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    good = F.coalesce((F.size(parts) > 2) & (F.translate(number, "0123456789", "") == "") & (number != "") & (F.translate(day, "0123456789", "##########") == "####-##-##"), F.lit(False))
    return files.where(good).select(number.alias("number"), F.try_to_date(day, "yyyy-MM-dd").alias("date"), path), files.where(~good).select(path)


LINK = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def page_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, href, title) of each link, tags in titles dropped."""
    found = F.posexplode(F.regexp_extract_all(html, F.lit(LINK), F.lit(0))).alias("pos", "_a")
    title = F.trim(F.regexp_replace(F.regexp_extract("_a", LINK, 2), r"<[^>]*>", ""))
    return pages.select(key, found).select(key, "pos", F.regexp_extract("_a", LINK, 1).alias("href"), title.alias("title"))


def report_links(pages: DataFrame, word: str = "sitrep", within: str = r"h[23]", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, title, href): links within such elements whose title holds the word, whatever the case."""
    parts = F.explode(F.regexp_extract_all(html, F.lit(rf"(?is)<({within})\b[^>]*>.*?</\1>"), F.lit(0)))
    links = page_links(pages.select(key, parts.alias("_h")), "_h", key)
    return links.where(F.lower("title").contains(word.lower())).select(key, "title", "href")


# Fixed value: the attribute in which pages embed a document's address, as base64 JSON.
EMBEDDED = r"pdfemb-data=([A-Za-z0-9+/=]+)"


def embedded_doc_url(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, url): the url in the first embedded base64 JSON that has one, else the first link to a .pdf."""
    tokens = F.regexp_extract_all(html, F.lit(EMBEDDED), F.lit(1))
    padded = lambda t: F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), "=")
    urls = F.transform(tokens, lambda t: F.get_json_object(F.try_to_binary(padded(t), F.lit("base64")).cast("string"), "$.url"))
    first = F.get(F.filter(urls, lambda u: u.isNotNull()), F.lit(0))
    anchor = F.nullif(F.regexp_extract(html, r"(?is)<a\s[^>]*href=[\"']([^\"']*\.pdf)[\"']", 1), F.lit(""))
    return pages.select(key, F.coalesce(first, anchor).alias("url"))


def expand_pages(listing: DataFrame, base: Column, pattern: str = r"/page/(\d+)", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, n, url): pages 1 to the greatest number that the listing mentions."""
    numbers = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int"))
    top = F.greatest(F.lit(1), F.coalesce(F.array_max(numbers), F.lit(1)))
    df = listing.select(key, base.alias("_b"), F.explode(F.sequence(F.lit(1), top)).alias("n"))
    return df.select(key, "n", F.when(F.col("n") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("page/"), F.col("n").cast("string"), F.lit("/"))).alias("url"))


def fetch_backlog(links: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    """Links not archived yet, each once."""
    return links.dropDuplicates([key]).join(archived.select(key), key, "left_anti")


def title_to_number(c: Column) -> Column:
    """The number after N, three digits wide; else the title's first 20 characters, other signs as underscores."""
    behind = F.transform(F.slice(F.split(F.upper(c), "N"), 2, 1000), lambda x: F.ltrim(x, F.lit("°O ")))
    first = F.get(F.filter(behind, lambda x: x.rlike("^[0-9]")), F.lit(0))
    number = F.coalesce(F.regexp_extract(first, "^0*([0-9]{1,3})", 1), F.lit(""))
    return F.when(number != "", F.lpad(number, 3, "0")).otherwise(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "_"), 1, 20))


def index_row(meta: DataFrame, totals: DataFrame, key: str = "sitrep") -> DataFrame:
    """Report index rows: identity, dates and totals, and whether the count could not be read."""
    df = meta.join(totals.select(key, "confirmed", "deaths"), key, "left")
    return df.withColumn("confirmed_extraction_failed", F.col("confirmed").isNull())
