"""URL filters with redirect equivalence, by DataFrame functions alone.

Parts: the host stands behind the first `://` up to `/`, `?`, `#` or the end (A-Z lower-cased), the path
goes on up to `?`, `#` or the end. Null urls and those without `://` have both empty.

Rules (host, path, decision): one fits its host and all subdomains where the url's path begins with its
path. The longest (host and path together) wins, of equally long ones that of the longer host, then allow.

Aliases: addresses are host, path and query; scheme and fragment tell none apart. Canonical links and
refreshes of pages, and redirects where given, are edges between addresses, and each connected component
is a class of aliases, whatever the edges' direction. An address's own rule decides for it, so an explicit
allow stands within any class; one without a rule is blocked if a rule blocks any alias of it, a page or
only named by a link, and allowed otherwise. Only blocks propagate, allows don't.

Links are read from `link` tags with rel=canonical and `meta` tags with http-equiv=refresh, wherever they
stand in the html. Relative ones are resolved by the page's host, path and folder; dot segments stay as
they are. Links with other schemes, and those of pages without a host, make no edge.

Rows are kept one to one, repeated ones and those with nulls alike; null html has no links, however long
html is read whole. Pages that share an address share its links. Empty tables give empty ones. Columns
of the caller don't matter but for those named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import written
from vigil.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, decision) of the query's contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def rest(url: Column) -> Column:
    """What stands behind the first `://`; empty if there is none."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def query_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^?#]*([^#]*)", 1)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules of a few lines; longer lists are read as tables with these columns."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(d).alias("decision")) for h, p, d in rules))
    return spark.range(1).select(F.inline(rows))


def decided(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses(host, path): distinct, not null. Those that a rule fits, with `rule` and `decision`.

    Each address looks up its host and the domains above it, and of those that have rules the beginnings
    of its path that are as long as one of theirs: equi-joins, whatever the number of rules.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "decision").distinct()
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    asked = addresses.select("host", "path", F.explode(domains).alias("rule_host")).join(lengths, "rule_host")
    asked = asked.select("host", "path", "rule_host", F.explode("lengths").alias("n")).where("n <= length(path)")
    fits = asked.withColumn("rule_path", F.expr("substring(path, 1, n)")).join(rules, ["rule_host", "rule_path"])
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("decision") == "allow")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "decision"), rank).alias("_r"))
    return best.select("host", "path", "_r.*")


def linked(html: Column) -> Column:
    """array<string>: targets of canonical links and refreshes, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    attribute = lambda tag, name: F.concat(*(F.regexp_extract(tag, rf"(?i)\s{name}{VALUE}", g) for g in (1, 2, 3)))

    def target(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)^<link\b") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = tag.rlike(r"(?i)^<meta\b") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
        to = F.regexp_extract(attribute(tag, "content"), r"""(?i)\burl\s*=\s*["']?([^"']*)""", 1)
        found = F.when(canonical, attribute(tag, "href")).when(refresh, to)
        return F.trim(F.replace(found, F.lit("&amp;"), F.lit("&")))

    return F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (t != ""))


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The target behind its scheme, `host/path?query`; null for other schemes and for places in the page itself."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), rest(target))
        .when(target.startswith("//"), F.regexp_replace(target, "^//", ""))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#"), None)
        .when(target.startswith("/"), F.concat(host, target))
        .when(target.startswith("?"), F.concat(host, path, target))
        .otherwise(F.concat(host, F.when(folder == "", "/").otherwise(folder), target))
    )


def node(host: Column, path: Column, query: Column) -> Column:
    """An address in 16 bytes; null without a host."""
    return F.when(host != "", F.unhex(F.md5(F.concat_ws("\n", host, path, query).cast("binary"))))


def parted(df: DataFrame, behind: str, prefix: str = "") -> DataFrame:
    """Adds host, path and node of what stands behind a scheme."""
    host, path, query = host_of(F.col(behind)), path_of(F.col(behind)), query_of(F.col(behind))
    return df.withColumns({f"{prefix}host": host, f"{prefix}path": path}).withColumn(f"{prefix}node", node(F.col(f"{prefix}host"), F.col(f"{prefix}path"), query))


def aliases(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Edges (node, host, path, to_node, to_host, to_path) of the pages' links and of redirects(from_url, to_url)."""
    own = parted(pages.select(rest(F.col(url)).alias("_rest"), linked(F.col(html)).alias("_links")).where(F.size("_links") > 0), "_rest")
    out = own.select("node", "host", "path", F.explode("_links").alias("_target"))
    out = out.select("node", "host", "path", resolved(F.col("_target"), F.col("host"), F.col("path")).alias("_rest"))
    if redirects is not None:
        sent = parted(redirects.select(rest(F.col("from_url")).alias("_from"), F.trim("to_url").alias("_target")), "_from")
        out = out.unionByName(sent.select("node", "host", "path", resolved(F.col("_target"), F.col("host"), F.col("path")).alias("_rest")))
    return parted(out, "_rest", "to_").drop("_rest").where("node IS NOT NULL AND to_node IS NOT NULL AND node <> to_node")


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node): addresses in classes where a rule blocks any address."""
    edges = written(edges)
    found = written(components(edges.select(F.col("node").alias("a"), F.col("to_node").alias("b"))))
    ends = edges.select("node", "host", "path").unionByName(edges.select(F.col("to_node").alias("node"), F.col("to_host").alias("host"), F.col("to_path").alias("path"))).distinct()
    bad = decided(ends.select("host", "path").distinct(), rules).where("decision = 'block'")
    roots = ends.join(bad, ["host", "path"], "left_semi").join(found, "node").select("root").distinct()
    return found.join(roots, "root", "left_semi").select("node")


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, by_alias): rule is that which fits the url itself, by_alias tells blocks that come from an alias."""
    own = parted(pages.select(F.col(key).alias("_key"), rest(F.col(url)).alias("_rest")), "_rest").drop("_rest")
    best = decided(own.select("host", "path").distinct(), rules)
    bad = blocked_aliases(aliases(pages, url, html, redirects), rules).withColumn("_bad", F.lit(True))
    out = own.join(best, ["host", "path"], "left").join(bad, "node", "left")
    by_alias = F.col("decision").isNull() & F.col("_bad").isNotNull()
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.when(by_alias, "block").otherwise(F.coalesce("decision", F.lit("allow"))).alias("verdict"), by_alias.alias("by_alias"))


def verdicts(pages: DataFrame) -> DataFrame:
    return judged(pages, rules_table(pages.sparkSession, RULES)).drop("by_alias")
