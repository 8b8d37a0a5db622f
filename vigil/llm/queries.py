"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm import bpe, divergence, infill, knn, language, mixing, orderminhash, quality, simhash, suffixes, toxicity, urls, windows
from vigil.llm.common import table


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digests(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.digests(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_suffix_array": op4_suffix_array,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_windows": op10_windows,
    "op11_divergence": op11_divergence,
    "op12_infill": op12_infill,
    "op13_url_filter": op13_url_filter,
}
#: What DuckDB can express of these; the others are tested against plain versions.
ORACLES: dict[str, str] = {
    "op4_suffix_array": """
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, encode(COALESCE(text, '')) AS b FROM documents),
p AS (SELECT r, b, UNNEST(generate_series(1, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400),
k AS (SELECT r, i, md5(b[i : i + 399]) AS key FROM p),
q AS (SELECT r, i FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING COUNT(*) > 1)),
m AS (SELECT r, i, CASE WHEN i - LAG(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM q),
t AS (SELECT r, i, SUM(new) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
g AS (SELECT r, run, MIN(i) AS a, MAX(i) + 399 AS z FROM t GROUP BY r, run),
h AS (SELECT g.r, a, z, b, octet_length(b) AS n, COALESCE(LAG(z) OVER (PARTITION BY g.r ORDER BY a), 0) AS before FROM g JOIN d ON g.r = d.r),
s AS (SELECT r, CAST(SUM(z - a + 1) AS BIGINT) AS n_removed, COUNT(*) AS n_spans,
        string_agg(hex(b[before + 1 : a - 1]), '' ORDER BY a) || hex(any_value(b)[MAX(z) + 1 : any_value(n)]) AS kept FROM h GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
  sha256(CASE WHEN s.r IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM d LEFT JOIN s ON d.r = s.r""",
    "op5_voronoi_knn": """
WITH w AS (SELECT ROW_NUMBER() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM w q JOIN w c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op10_windows": r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, UNNEST(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS key FROM p),
g AS (SELECT DISTINCT r, UNNEST(generate_series(i, i + 34)) AS j FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING COUNT(*) > 1)),
x AS (SELECT r, UNNEST(w) AS word, UNNEST(generate_series(1, len(w))) AS j FROM d),
s AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.j) AS kept, COUNT(*) AS n FROM x ANTI JOIN g ON x.r = g.r AND x.j = g.j GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r""",
    "op11_divergence": r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, UNNEST(w) AS term FROM d),
k AS (SELECT lang, term, COUNT(*) AS n FROM t GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 10),
v AS (SELECT lang, COUNT(*) AS v, SUM(n) AS size FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, COUNT(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT x.lang, x.source, COALESCE(v, 0) AS v, COALESCE(s.size, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN v ON x.lang = v.lang LEFT JOIN (SELECT lang, source, SUM(n) AS size FROM c GROUP BY lang, source) s ON x.lang = s.lang AND x.source = s.source),
p AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 2)) // (g.size + 2 * g.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (v.size + 2 * v.v)::HUGEINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10""",
    "op12_infill": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, t, w, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, LEAST(h1 % (n + 1), h2 % (n + 1)) AS a, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256 FROM p""",
    "op13_url_filter": r"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*([^#]*)', 1) AS query FROM u),
t AS (SELECT host, path, query, UNNEST(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''),
f AS (SELECT host, path, query, replace(trim(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?(?:[^"''>]*\s)?canonical["''\s/>]') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''>\s]*)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh["''\s/>]') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>\s]*)', 1) END), '&amp;', '&') AS target FROM t),
l AS (SELECT host, path, query, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, instr(target, '://') + 3) WHEN starts_with(target, '//') THEN substr(target, 3)
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(target, '#') THEN NULL WHEN starts_with(target, '/') THEN host || target WHEN starts_with(target, '?') THEN host || path || target
    ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || target END AS r FROM f WHERE target <> ''),
e AS (SELECT (host, path, query) AS a, (translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1), regexp_extract(r, '^[^?#]*([^#]*)', 1)) AS b FROM l WHERE r <> ''),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT a, a[1] AS host, a[2] AS path FROM (SELECT DISTINCT a FROM b) UNION SELECT DISTINCT (host, path, query), host, path FROM p),
rules(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (SELECT n.a, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v FROM n JOIN rules ON (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, s) GROUP BY n.a),
bad(a) AS (SELECT a FROM j WHERE v = 'block' UNION SELECT b.b FROM bad JOIN b ON bad.a = b.a)
SELECT page_id, host, path, j.rule, COALESCE(j.v, CASE WHEN (host, path, query) IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN j ON j.a = (p.host, p.path, p.query)""",
}
