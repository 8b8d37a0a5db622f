"""Worked examples and properties."""

import datetime
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from compare import rows
from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.operators import extract as X
from vigil.operators import geo as G
from vigil.operators import history as H
from vigil.operators import match as M
from vigil.operators import quality as Q
from vigil.operators import series as S
from vigil.operators import views as V
from vigil.plans.queries import ORACLES, QUERIES
from vigil.sources import catalog as C
from vigil.sources import parts as P
from vigil.streaming import ingest as I

ROOT = str(Path(__file__).parent.parent)

DAY = datetime.date(2026, 7, 1)


def days(spark, values, field="v"):
    rows = [("o", DAY + datetime.timedelta(days=n), v) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, d date, {field} bigint")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_increments(spark):
    out = S.increments(days(spark, [10, None, 8, 15]), "v", ["k"]).orderBy("d").collect()
    assert [r["increment"] for r in out] == [None, None, 0, 7]


def test_catchup_sums_to_the_increment(spark):
    df = S.increments(days(spark, [100, 469, 480]), "v", ["k"])
    over = spark.createDataFrame([("o", DAY + datetime.timedelta(days=1), 97)], "k string, d date, override bigint")
    out = S.split_catchup(df, over, ["k", "d"]).orderBy("d").collect()
    assert [(r["reported"], r["catchup"]) for r in out] == [(None, 0), (97, 272), (11, 0)]


def test_bridge_leaves_ends_alone(spark):
    df = spark.createDataFrame([("o", DAY + datetime.timedelta(days=n), v) for n, v in enumerate([None, 10.0, None, 20.0, None])], "k string, d date, v double")
    out = S.bridge_gaps(df, "v", ["k"]).orderBy("d").collect()
    assert [r["bridged"] for r in out] == [None, 10.0, 15.0, 20.0, None]
    assert [r["illustrative"] for r in out] == [False, False, True, False, False]


@pytest.mark.parametrize(("a", "b"), [("BAMBU", "Bambu"), ("Oicha**", "Oicha"), ("Nia-Nia", "Nia Nia"), ("Makiso--Kisangani", "Makiso-Kisangani"), ("Gethy", "Gety")])
def test_zone_keys(spark, a, b):
    assert one(spark, T.zone_key_upper(F.lit(a))) == one(spark, T.zone_key_upper(F.lit(b)))


def test_report_ids_are_ordered_as_text(spark):
    ids = [one(spark, T.report_id(F.lit(n))) for n in ("SitRep_093.pdf", "SitRep_093bis.pdf", "094.pdf")]
    assert ids == ["093", "093-bis", "094"] == sorted(ids)
    assert one(spark, T.report_id(F.lit("notes.pdf"))) is None


@pytest.mark.parametrize(("text", "n"), [("1 878", 1878), ("", None), ("NA", None), (" nd", None), (None, None), ("x", None)])
def test_norm_int(spark, text, n):
    assert one(spark, T.norm_int(F.lit(text).cast("string"))) == n


@pytest.mark.parametrize(("text", "n"), [("81,5%", 81.5), ("81.5", 81.5), ("81 %", 81.0), ("6 043", None), ("NA", None)])
def test_norm_pct(spark, text, n):
    assert one(spark, T.norm_pct(F.lit(text))) == n


def test_classes_and_levels(spark):
    rates = [one(spark, T.rate_class(F.lit(x).cast("double"))) for x in (29.9, 30, 49.9, 50, None)]
    assert rates == ["low", "mid", "mid", "high", "low"]
    assert [one(spark, T.intensity_level(F.lit(x))) for x in (0, 9, 10, 50, 200)] == [0, 1, 2, 3, 4]


def test_months(spark):
    assert [one(spark, T.month_number(F.lit(m))) for m in ("Aout", "août", "Décembre", "brumaire")] == [8, 8, 12, None]


def test_split_by_rate(spark):
    cut = one(spark, X.split_by_rate(F.split(F.lit("4257 1 878"), " "), F.lit(44.1)))
    assert (cut["cases"], cut["deaths"]) == (4257, 1878)
    assert one(spark, X.split_by_rate(F.split(F.lit("4257"), " "), F.lit(44.1))) is None


def test_split_to_known(spark):
    assert one(spark, X.split_to_known(F.split(F.lit("1 460 452"), " "), F.lit(1460), F.lit(452))) == 2
    assert one(spark, X.split_to_known(F.split(F.lit("1 460 452"), " "), F.lit(1461), F.lit(452))) is None


def test_unwrap(spark):
    lines = ["Nord-", "680 463 68,1% 17 10 1 11", "Kivu", "Boma", "5 6", "Mangbetu", "7 8", "Ango", "end of it"]
    df = spark.createDataFrame([("a", n, x) for n, x in enumerate(lines)], "doc string, line_no int, line string")
    out = [r["line"] for r in X.unwrap_names(df, ["doc"]).orderBy("line_no").collect()]
    assert out == ["Nord-Kivu 680 463 68,1% 17 10 1 11", "Boma Mangbetu 5 6", "7 8", "Ango", "end of it"]


def test_last_three(spark):
    cells = F.array(F.lit("x"), F.lit(None).cast("string"), F.lit("5"), F.lit(""), F.lit("13"), F.lit("18"))
    assert tuple(one(spark, X.last_three_checked(cells))) == (5, 13, 18)
    assert one(spark, X.last_three_checked(F.array(F.lit("1"), F.lit("2"), F.lit("4")))) is None


def test_contact_total_line(spark):
    df = spark.createDataFrame([("a", 0, "Tableau 4. Suivi des contacts"), ("a", 1, "Total 9 971 8 126 81,5%")], "doc string, line_no int, line string")
    row = X.contact_rate_lines(df, "Suivi des contacts", ["doc"]).first()
    assert (row["rate"], row["computed"]) == (81.5, 81.5)


def test_targets_are_no_rates(spark):
    df = spark.createDataFrame([("le suivi des contacts, cible 95%, ... Le suivi des contacts est de 71,2 %",)], "text string")
    assert X.contact_rate_prose(df, "suivi des contacts").first()["rate"] == 71.2


def test_homonyms_do_not_match_across_provinces(spark):
    ours = spark.createDataFrame([("Mongbwalu", "A"), ("Beni", "A")], "zone string, province string")
    ref = spark.createDataFrame([("Beni", "B"), ("Beni", "C"), ("mongbwalu", "X")], "zone string, province string")
    out = {r["zone"]: r["matched"] for r in M.resolve_zone(ours, ref).collect()}
    assert out == {"Mongbwalu": "mongbwalu", "Beni": None}


def test_asof_takes_the_row_of_the_same_day(spark):
    s = spark.createDataFrame([("o", DAY, 1), ("o", DAY + datetime.timedelta(days=2), None)], "k string, d date, v bigint")
    e = spark.createDataFrame([("o", DAY, "a"), ("o", DAY + datetime.timedelta(days=3), "b"), ("o", DAY - datetime.timedelta(days=1), "c")], "k string, d date, n string")
    out = {r["n"]: r["v"] for r in M.asof_join(e, s, ["k"], ["v"], known="v").collect()}
    assert out == {"a": 1, "b": 1, "c": None}


def test_upsert_is_idempotent_and_batches_in_order_equal_one(spark):
    h = days(spark, [1, 2, 3])
    u = days(spark, [5, 6])
    once = H.upsert(h, u, ["k", "d"])
    twice = H.upsert(once, u, ["k", "d"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert sorted(r["v"] for r in once.collect()) == [3, 5, 6]


def test_carry_forward_loses_no_zone(spark):
    rows = [("A", "p", DAY, 1), ("B", "p", DAY, 2), ("A", "p", DAY + datetime.timedelta(days=1), 3), ("C", "p", DAY + datetime.timedelta(days=2), 9)]
    df = spark.createDataFrame(rows, "zone string, province string, d date, cases bigint")
    out = H.carry_forward(df, df.select("d"), ["province", "zone"], ["cases"]).where(F.col("d") == DAY + datetime.timedelta(days=2))
    assert {(r["zone"], r["cases"], r["carried"]) for r in out.collect()} == {("A", 3, True), ("B", 2, True), ("C", 9, False)}


def test_diff_of_itself_is_empty(spark):
    df = days(spark, [1, None, 3])
    assert H.diff_versions(df, df, ["k", "d"], "v").count() == 0


def test_rate_tolerance_has_a_hair_of_slack(spark):
    df = spark.createDataFrame([("a", 1000, 501, 50.0), ("b", 1000, 502, 50.0)], "k string, cases bigint, deaths bigint, cfr double")
    out = {r["scope"]: r["ok"] for r in Q.check_rates(df, F.col("k"), 0.1).collect()}
    assert out == {"a": True, "b": False}


def test_simplified_rings_stay_within_the_tolerance(spark):
    line = [(0, 0.0, 0.0), (1, 1.0, 0.01), (2, 2.0, 1.0), (3, 3.0, 0.02), (4, 4.0, 0.0), (5, 2.0, -1.0), (6, 0.0, 0.0)]
    df = spark.createDataFrame([("z", 0, *v) for v in line], "zone_id string, ring_no int, seq int, lon double, lat double")
    kept = sorted(r["seq"] for r in G.simplify_rings(df, F.lit(0.2)).collect())
    assert {0, 2, 6} <= set(kept) and len(kept) >= 4
    all_kept = sorted(r["seq"] for r in G.simplify_rings(df, F.lit(100.0)).collect())
    assert len(all_kept) >= 4  # finer tolerances until a ring is left


def test_rings_that_split_deeply_keep_what_strays(spark):
    # each round settles one vertex only, the last but one of what is left
    df = spark.createDataFrame([(1, 0, i, float(i), 125.0**i) for i in range(71)], "zone_id int, ring_no int, seq int, lon double, lat double")
    assert sorted(r["seq"] for r in G.simplify_rings(df, F.lit(0.2)).collect()) == list(range(71))


def test_features_are_json(spark):
    import json

    attrs = spark.createDataFrame([(1, "Z")], "zone_id int, name string")
    v = spark.createDataFrame([(1, 0, 1, 2.0, 3.0), (1, 0, 0, 1.0, 1.0)], "zone_id int, ring_no int, seq int, lon double, lat double")
    got = json.loads(G.to_features(attrs, v).first()["feature"])
    assert got == {"type": "Feature", "properties": {"name": "Z"}, "geometry": {"type": "Polygon", "coordinates": [[[1.0, 1.0], [2.0, 3.0]]]}}


ENTRY = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert {{"w1_increments", "q15_verdict"}} <= set(q) and set(o) <= set(q)
assert not [x for x in q if x.startswith("op") or x == "pipeline"], sorted(q)
"""


@pytest.mark.parametrize("names", [("public_tokenizers",), ("xxhash",), ("vigil.llm",)])
def test_entry_stands_without_a_package(names):
    subprocess.run([sys.executable, "-c", ENTRY.format(names=names)], cwd=ROOT, check=True)


def test_entry_stands_without_the_subpackage(tmp_path):
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.md", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=away)
    subprocess.run([sys.executable, "-c", ENTRY.format(names=())], cwd=tmp_path / "copy", check=True, env={**os.environ, "PYTHONPATH": ""})


def lines_of(spark, *lines):
    return spark.createDataFrame([("a", n, x) for n, x in enumerate(lines)], "doc string, line_no int, line string")


def test_zone_lines_with_thousands_apart_and_without_counts(spark):
    lines = ["Bunia 1 878 452 24,1% 3 1", "Beni NA NA NA", "Nia-Nia* 12 3 25 % 4", "Oicha 12 NA NA 5", "Mambasa 0 0 0,0%", "Tableau 3 : zones", "12 4 33,3%", "Boma Mangbetu 1 200 1 150 95,8%"]
    out = {r["name"]: (r["cases"], r["deaths"], r["cfr"], r["tail"]) for r in X.parse_zone_lines(lines_of(spark, *lines)).collect()}
    assert out == {
        "Bunia": (1878, 452, 24.1, [3, 1]), "Beni": (None, None, None, []), "Nia-Nia": (12, 3, 25.0, [4]), "Oicha": (12, None, None, [5]),
        "Mambasa": (0, 0, 0.0, []), "Boma Mangbetu": (1200, 1150, 95.8, []),
    }


def test_totals_with_thousands_apart(spark):
    df = lines_of(spark, "Ituri 680 463 68,1% 17 10 1 11", "Total 4 257 1 878 44,1% 12 3 1 4", "Ituri 1 680 463 27,6% 1 017 10 1 11", "Total 1 1 100% 1 1 1 1", "Total 5 4 80%")
    total = X.detail_total(df, ["doc"]).first()
    assert (total["cases"], total["deaths"], total["cfr"], total["new_cases"], total["total"]) == (4257, 1878, 44.1, 12, 4)
    sub = X.province_subtotals(df, ["doc"]).collect()
    assert [(r["name"], r["cases"], r["deaths"], r["new_cases"], r["deaths_community"]) for r in sub] == [("Ituri", 1680, 463, 1017, 10)]


def test_province_lines(spark):
    lines = ["Ituri** 4257 1 878 44,1% 12/36 (33,3%) 7", "Bas Uélé 12 3 25,0 % 2 sur 11 0", "Total 1 2 3", "Nord-Kivu 10 5 50% 3 7"]
    out = [tuple(r[c] for c in ("name", "confirmed", "deaths", "zones", "zones_total", "new_cases")) for r in X.parse_province_lines(lines_of(spark, *lines)).orderBy("line_no").collect()]
    assert out == [("Ituri", 4257, 1878, 12, 36, 7), ("Bas Uélé", 12, 3, 2, 11, 0)]


def test_names_of_weekly_files_and_titles(spark):
    files = spark.createDataFrame([("x/Weekly_Report_07_2026-05-30.pdf",), ("x/Weekly_7_2026-05-30.txt",), ("Weekly_a7_2026-05-30.pdf",), ("_8_2026-13-30.pdf",)], "path string")
    good, bad = C.weekly_index(files)
    assert {(r["number"], str(r["date"])) for r in good.collect()} == {("07", "2026-05-30"), ("8", "None")} and bad.count() == 2
    titles = {"SitRep N° 045 du 12 mai": "045", "sitrep n7": "007", "Note mai": "Note_mai", "N°1234": "123", "Rapport NO 12": "012"}
    assert {t: one(spark, C.title_to_number(F.lit(t))) for t in titles} == titles


def test_aliases_name_the_same_place(spark):
    ours = spark.createDataFrame([("Muku", "A"), ("Beni", "A")], "zone string, province string")
    ref = spark.createDataFrame([("Mukú Centre", "A"), ("beni", "A")], "zone string, province string")
    out = {r["zone"]: r["matched"] for r in M.resolve_zone(ours, ref, {"muku": "Mukú centre"}).collect()}
    assert out == {"Muku": "Mukú Centre", "Beni": "beni"}


def test_last_known_of_each_field(spark):
    rows = [("a", DAY, 1, None), ("a", DAY + datetime.timedelta(days=2), 5, 7), ("a", DAY + datetime.timedelta(days=1), 3, 6), ("a", DAY + datetime.timedelta(days=3), None, 8), ("b", DAY, None, None)]
    df = spark.createDataFrame(rows, "k string, d date, x bigint, y bigint")
    out = {r["k"]: (r["last_x"], r["previous_x"], r["last_y"], r["previous_y"], r["last_y_date"]) for r in S.last_known(df, ["x", "y"], ["k"]).collect()}
    assert out == {"a": (5, 3, 8, 7, DAY + datetime.timedelta(days=3)), "b": (None, None, None, None, None)}


def test_recomputing_equals_the_whole(spark):
    rows = [(z, DAY + datetime.timedelta(days=n), 10 * n + len(z)) for n in range(8) for z in ("A", "BB", "CCC") if (n + len(z)) % 3]
    df = spark.createDataFrame(rows, "zone string, d date, cases bigint")
    whole = H.carry_forward(df, df.select("d"), ["zone"], ["cases"])
    for n in (0, 1, 5):
        begin = DAY + datetime.timedelta(days=n)
        got = H.recompute_from(df, df.where(F.col("d") == begin), ["zone"], ["cases"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.where(F.col("d") >= begin).collect()))
    assert H.recompute_from(df, df.limit(0), ["zone"], ["cases"]).count() == 0


def test_a_new_checkpoint_loses_nothing_and_touches_its_parts_only(spark, tmp_path):
    schema, history = "k string, d date, v bigint", f"{tmp_path}/history"

    def feed(rows, source, seen):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/{source}")
        I.ingest_stream(spark, f"{tmp_path}/{source}", schema, history, f"{tmp_path}/{seen}", ["k", "d"], F.date_format("d", "yyyy-MM")).awaitTermination()
        return sorted(map(tuple, I.current(spark, history, schema).collect()))

    june = datetime.date(2026, 6, 3)
    assert feed([("a", DAY, 1), ("b", june, 2)], "one", "seen1") == [("a", DAY, 1), ("b", june, 2)]
    of_june = lambda: P.manifest(spark, history).tables["rows"]["2026-06"]
    folder = of_june()
    assert feed([("a", DAY, 5), (None, DAY, 9)], "one", "seen1") == [("a", DAY, 5), ("b", june, 2)]
    assert of_june() == folder
    assert feed([("c", DAY, 7)], "two", "seen2") == [("a", DAY, 5), ("b", june, 2), ("c", DAY, 7)]
    assert [r[0] for r in feed([("e", june, 8)], "two", "seen3")] == ["a", "b", "c", "e"]


def test_stale_artifacts_as_not_in(spark):
    prev = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "path string")
    stale = lambda *paths: sorted((r[0] for r in V.stale_artifacts(prev, spark.createDataFrame([(p,) for p in paths], "path string")).collect()), key=str)
    assert stale("b", "c") == ["a", "a"] and stale("b", None) == [] and stale() == [None, "a", "a", "b"]


def test_split_by_rate_keeps_thousands_whole(spark):
    cut = lambda words, rate: tuple(one(spark, X.split_by_rate(F.split(F.lit(words), " "), F.lit(rate))))
    assert cut("21 000 0", 0.0) == (21000, 0) and cut("1 400 000 0", 0.0) == (1400000, 0) and cut("21 000 000 7 000", 0.0) == (21000000, 7000)
    assert cut("3240 000 0", 0.0) == (3240000, 0) and cut("42 57 18 78", 44.1) == (4257, 1878)
    lines = lines_of(spark, "Ituri 21 000 0 0,0% 1 204 30 2 9", "Total 21 000 0 0,0% 1 204 30 2 9")
    assert [r["cases"] for r in X.province_subtotals(lines, ["doc"]).collect()] == [21000] and X.detail_total(lines, ["doc"]).first()["cases"] == 21000


def test_text_rows_only_where_a_document_has_no_cell_rows(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc string, name string")
    out, rejects = X.province_summary(rows(("a", "x"), ("a", "y")), rows(("a", "z"), ("b", "w")), rows(("a", ""), ("b", ""), ("c", "")).select("doc"), ["doc"])
    assert sorted(map(tuple, out.collect())) == [("a", "x", "cells"), ("a", "y", "cells"), ("b", "w", "text")] and [r[0] for r in rejects.collect()] == ["c"]


def against_sql(spark, folder, name, **tables):
    """A query's rows over these tables, and those of its SQL."""
    db = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)), db.sql(ORACLES[name])
    return rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())


def test_printed_number_before_a_text_of_digits(spark, tmp_path):
    texts = ["5 mai", "12", None, "", "SitRep N° 0 7", "7 sitrep\nn 12 a", "x"]
    docs = spark.createDataFrame([(n, texts[n % 7], 40 + n) for n in range(56)], "doc_id bigint, text string, n_chars bigint")
    got, want = against_sql(spark, tmp_path, "x2_bulletin_meta", documents=docs)
    assert got == want and len(got[1]) == 56


def test_known_values_of_a_million(spark, tmp_path):
    day = F.date_add(F.lit("2026-05-30").cast("date"), (F.col("id") % 2).cast("int"))
    orders = spark.range(2_100_000).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), day.alias("o_orderdate"), F.lit("F").alias("o_orderstatus"))
    made = {"customer": "1 AS c_custkey, 1 AS c_nationkey", "nation": "1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey", "region": "1 AS r_regionkey, 'ASIA' AS r_name"}
    got, want = against_sql(spark, tmp_path, "x9_split_to_known", orders=orders, **{t: spark.sql(f"SELECT {c}") for t, c in made.items()})
    assert got == want and len(got[1]) == 2


def test_words_end_at_ascii_letters(spark, tmp_path):
    texts = ["mod\u00e8les", "les", "bless", "une 5 %", None, "", "\u00ebthe the the the the", "der der \u00fcder", "les\u00e9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for name in ("x35_coverage_scan", "x36_classify_format"):
        got, want = against_sql(spark, tmp_path / name, name, documents=docs)
        assert got == want and got[1]
    assert [(r["found"], r["missing"]) for r in X.coverage_scan(docs.limit(0), {"m": "x"}).collect()] == [(0, 0)]
    assert T.ascii_edges(r"\\b\d\b") == r"\\b\d" + T.EDGE
