"""Results that stay equal where keys are hot, tables large or geometry deep, and plans that stay small."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import geo as G
from vigil.operators import match as M
from vigil.operators import quality as Q
from vigil.operators import segments as W
from vigil.operators import series as S
from vigil.plans.queries import QUERIES

DAY = datetime.date(2026, 1, 1)


def on(n):
    return DAY + datetime.timedelta(days=n)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["x6_parse_zone_lines", "x7_parse_province_lines", "x10_province_subtotals", "x11_detail_total", "x41_province_summary", "x44_summary_outcome"])
def test_parsers_have_small_plans(spark, name):
    """Results are bound once; named again and again they made half a million characters."""
    assert len(plan(QUERIES[name](spark, "/root/testdata/sf0.001"))) < 30_000


# --- segmented scans


def hot(rng, n=3000):
    """(k, d, v, n): nine in ten rows are of one key, a null key is one too."""
    return [(rng.choice(["hot"] * 27 + ["a", None, "b"]), on(rng.randint(0, 400)), rng.choice([None, rng.randint(-5, 50)]), i) for i in range(n)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_filled_equals_one_window_a_key(spark, inclusive):
    df = spark.createDataFrame(hot(random.Random(1)), "k string, d date, v int, n int")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("d", "n").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumn("last", F.last("v", ignorenulls=True).over(w))
    got = W.filled(df, F.col("v"), ["k"], ["d", "n"], F.trunc("d", "month"), "last", inclusive)
    assert got.columns == want.columns and rows(got, *df.columns, "last") == rows(want, *df.columns, "last")
    total = W.running_sum(df, F.col("v"), ["k"], ["d", "n"], F.trunc("d", "month"), "total")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    assert rows(total, *df.columns, "total") == rows(df.withColumn("total", F.sum("v").over(w)), *df.columns, "total")


def test_no_task_of_a_scan_has_more_than_a_segment(spark):
    """The only windows over rows are partitioned by key and segment; the other one is over segments."""
    df = spark.createDataFrame(hot(random.Random(2)), "k string, d date, v int, n int")
    got = W.filled(df, F.col("v"), ["k"], ["d", "n"], F.trunc("d", "month"), "last")
    largest = got.withColumn("m", F.trunc("d", "month")).groupBy("k", "m").count().agg(F.max("count")).first()[0]
    assert largest < 0.1 * df.where("k = 'hot'").count()
    text = got._jdf.queryExecution().optimizedPlan().toString()
    over = {line.split("], [")[1] for line in text.splitlines() if "windowspecdefinition(" in line and "_first" in line}
    assert len(over) == 1 and "_seg" in over.pop()


def test_asof_join_of_a_hot_key(spark):
    rng = random.Random(3)
    events = [(k, d, n) for k, d, _, n in hot(rng, 500)]
    known = {(k, d): v for k, d, v, _ in hot(rng, 2000)}
    series = spark.createDataFrame([(k, d, v) for (k, d), v in known.items()], "k string, d date, v int")
    for only in (None, "v"):
        got = rows(M.asof_join(spark.createDataFrame(events, "k string, d date, n int"), series, ["k"], ["v"], known=only), "k", "d", "n", "asof_date", "v")
        want = []
        for k, d, n in events:
            at = max((x for (o, x), v in known.items() if o == k and x <= d and (only is None or v is not None)), default=None)
            want.append((k, d, n, at, known.get((k, at))))
        assert got == sorted(want, key=repr)


def test_cumulative_of_a_hot_key_and_increments_by_segment(spark):
    rng = random.Random(4)
    incr = [(k or "none", d, v or 0) for k, d, v, _ in hot(rng, 2000)]
    dates = sorted({(k, on(n)) for k in ("hot", "a", "never") for n in range(-5, 420, 7)})
    got = rows(M.cumulative_at(spark.createDataFrame(incr, "k string, d date, v bigint"), spark.createDataFrame(dates, "k string, d date"), "v", ["k"]), "k", "d", "total")
    assert got == sorted(((k, d, sum(v for o, x, v in incr if o == k and x <= d)) for k, d in dates), key=repr)
    series = spark.createDataFrame([("o", on(n), None if n % 7 == 3 else n * n % 50) for n in range(300)], "k string, d date, v bigint")
    assert rows(S.increments(series, "v", ["k"], segment=F.trunc("d", "month")), "d", "increment") == rows(S.increments(series, "v", ["k"]), "d", "increment")


# --- names


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def names(rng, n, length=(0, 9), letters="abcd"):
    return sorted({"".join(rng.choices(letters, k=rng.randint(*length))) for _ in range(n)})


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_names_lose_no_pair(spark, most):
    rng = random.Random(most)
    a, b = names(rng, 60), names(rng, 60)
    left, right = (spark.createDataFrame([("p", x) for x in xs], f"p string, {k} string") for xs, k in ((a, "_k"), (b, "_rk")))
    got = {(r["_k"], r["_rk"]) for r in M.near_names(left, right, "p", most).collect()}
    assert {(x, y) for x in a for y in b if levenshtein(x, y) <= most} <= got


@pytest.mark.parametrize("cutoff", [0.3, 0.5, 0.6, 0.75, 0.9, 1.0])
def test_gram_pairs_lose_no_pair(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    a, b = names(rng, 60, (1, 12)), names(rng, 60, (1, 12))
    left, right = (spark.createDataFrame([("p", x) for x in xs], f"p string, {k} string") for xs, k in ((a, "_k"), (b, "_rk")))
    got = {(r["_k"], r["_rk"]) for r in M.gram_pairs(left, right, "p", cutoff).collect()}
    assert {(x, y) for x in a for y in b if round(1 - levenshtein(x, y) / max(len(x), len(y)), 6) >= cutoff} <= got


def test_few_names_are_compared(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(6, 14)))
    known = [word() for _ in range(2000)]
    ours = [x[:3] + "q" + x[4:] for x in known[:1000]] + [word() for _ in range(500)]
    left = spark.createDataFrame([("p", x) for x in ours], "p string, _k string")
    right = spark.createDataFrame([("p", x) for x in known], "p string, _rk string")
    assert 1000 <= M.near_names(left, right, "p", 2).count() < 5000  # of three million
    assert 1000 <= M.gram_pairs(left, right, "p", 0.6).count() < 30_000


def test_fuzzy_match_and_candidates_against_all_pairs(spark):
    rng = random.Random(7)
    ours = [(x, p) for x in names(rng, 40, (1, 7)) for p in rng.sample(["P", "Q", "R"], 2)] * 2
    known = [(x.upper(), p) for x in names(rng, 40, (1, 7)) for p in rng.sample(["P", "Q"], 1)]
    a, b = (spark.createDataFrame(x, "zone string, province string") for x in (ours, known))
    want, exact = [], {}
    for x, _ in sorted(known):
        exact.setdefault(x.lower(), x)
    for x, p in ours:
        near = min(((levenshtein(x, y.lower()), y) for y, q in known if q == p and levenshtein(x, y.lower()) <= 2), default=None)
        want.append((x, p, exact[x], 0, "exact") if x in exact else (x, p, near[1], near[0], "spelling") if near else (x, p, None, None, "missing"))
    assert rows(M.fuzzy_match(a, b), "zone", "province", "matched", "distance", "status") == sorted(want, key=repr)
    one = a.distinct()
    want = []
    for x, p in set(ours):
        scored = sorted((-round(1 - levenshtein(x, y.lower()) / max(len(x), len(y)), 6), y) for y, q in known if q == p)
        want += [(x, p, y, -s, n + 1) for n, (s, y) in enumerate([z for z in scored if -z[0] >= 0.6][:3])]
    assert rows(M.name_candidates(one, b), "zone", "province", "candidate", "score", "rank") == sorted(want, key=repr)


# --- places


def test_boxes_meet_once_whatever_their_sizes(spark):
    rng = random.Random(8)

    def box(n):
        w, h = (rng.choice([0, 2 ** rng.uniform(-12, 9), 2.0 ** rng.randint(-3, 5)]) for _ in range(2))
        x, y = rng.choice([rng.uniform(-180, 180), float(rng.randint(-8, 8))]), rng.choice([rng.uniform(-90, 90), 0.0])
        return n, x, y, x + w, y + h

    boxes, frames = [box(n) for n in range(300)], [box(n) for n in range(120)]
    a, b = (spark.createDataFrame(x, "n int, x0 double, y0 double, x1 double, y1 double") for x in (boxes, frames))
    met = M.boxes_that_meet(a, b)
    got = sorted((r["_a"]["n"], r["_b"]["n"]) for r in met.collect())
    assert got == sorted((p[0], q[0]) for p in boxes for q in frames if p[3] >= q[1] and p[1] <= q[3] and p[4] >= q[2] and p[2] <= q[4]) and got
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)
    assert M.boxes_that_meet(a.limit(0), b).count() == M.boxes_that_meet(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["j12_frame_zones", "j13_frame_landmarks"])
def test_frames_are_joined_by_cells(spark, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Cartesian" not in text and "BroadcastNestedLoopJoin BuildRight, Inner" not in text and "BroadcastNestedLoopJoin" not in text


def plain_thinned(points, tol):
    """Douglas-Peucker with a stack of open segments."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        long = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        best, at = tol, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / long if long > 0 else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5
            if d > best:
                best, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return sorted(keep)


def test_a_ring_of_100_000_vertices(spark):
    import math

    rng = random.Random(9)
    n = 100_000
    points = [(math.cos(2 * math.pi * i / n) * (10 + rng.uniform(-0.01, 0.01)), math.sin(2 * math.pi * i / n) * (10 + rng.uniform(-0.01, 0.01))) for i in range(n)]
    small = [[(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(60)] for _ in range(5)]
    table = [(0, 0, i, *p) for i, p in enumerate(points)] + [(k + 1, 0, i, *p) for k, ring in enumerate(small) for i, p in enumerate(ring)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(table, columns=["zone_id", "ring_no", "seq", "lon", "lat"])).repartition(4)
    got = {}
    for r in G.simplify_rings(df, F.lit(0.5)).select("zone_id", "seq").collect():
        got.setdefault(r["zone_id"], []).append(r["seq"])
    for k, ring in enumerate([points, *small]):
        assert sorted(got[k]) == plain_thinned(ring, 0.5)


# --- the gate


def test_gate_in_one_pass(spark):
    zones = [("d1", "P", "a", 5, 1), ("d1", "P", "b", 5, 2), ("d1", "Q", "c", -1, 0), ("d1", "Q", "e", 3, 4), ("d2", "P", "a", 1, 0)]
    provinces = [("d1", "P", 10, 3, 30.0, 2), ("d1", "Q", 3, 4, 133.5, 1), ("d1", "R", 7, None, 0.0, 1), ("d2", "P", 2, 0, 0.0, 1)]
    national = [("d1", 20, 7, 35.3, 4), ("d2", 2, 0, 0.0, 1), ("d3", 0, 0, None, None)]
    z = spark.createDataFrame(zones, "d string, province string, zone string, cases int, deaths int")
    p = spark.createDataFrame(provinces, "d string, province string, cases int, deaths int, cfr double, zones int")
    n = spark.createDataFrame(national, "d string, cases int, deaths int, cfr double, zones int")
    out = Q.gate(z, p, n, "d")
    got = {(r["check_id"], r["scope"]): (r["expected"], r["actual"], r["ok"], r["blocking"]) for r in out.collect()}
    assert got == {
        ("rollup_cases", "d1"): (20, 20, True, True), ("rollup_deaths", "d1"): (7, 7, True, True), ("declared_zones", "d1"): (4, 4, True, True), ("zone_count", "d1"): (4, 4, True, False), ("rate", "d1"): (35.0, 35.3, False, True),
        ("rollup_cases", "d2"): (2, 2, True, True), ("rollup_deaths", "d2"): (0, 0, True, True), ("declared_zones", "d2"): (1, 1, True, True), ("zone_count", "d2"): (1, 1, True, False), ("rate", "d2"): (0.0, 0.0, True, True),
        ("rollup_cases", "d3"): (0, 0, True, True), ("rollup_deaths", "d3"): (0, 0, True, True), ("declared_zones", "d3"): (0, 0, True, True), ("zone_count", "d3"): (0, 0, True, False),
        ("zone_sums", "d1/P"): (10, 10, True, False), ("zone_sums", "d1/Q"): (3, 2, False, False), ("zone_sums", "d2/P"): (2, 1, False, False),
        ("rate", "d1/P"): (30.0, 30.0, True, True), ("rate", "d1/Q"): (133.3, 133.5, False, True), ("rate", "d1/R"): (0.0, 0.0, True, True), ("rate", "d2/P"): (0.0, 0.0, True, True),
        ("non_negative", "d1/Q/c"): (0, -1, False, True), ("deaths_le_cases", "d1/Q/c"): (-1, 0, False, True), ("deaths_le_cases", "d1/Q/e"): (3, 4, False, True),
    }
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") == 3 and text.count("Aggregate [") == 1  # each input once, one roll-up


def test_expected_range_of_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["u4_expected_range"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("text", "number"), [("SitRep MVE N° 058 du 1", "058"), ("SITREP  mve n°12", "012"), ("SitRep Nº 7", "007"), ("SitRep N 103", "103"), ("SitRep MVE 12", None)])
def test_printed_numbers(spark, text, number):
    from vigil.operators import extract as X

    df = spark.createDataFrame([(text, None), (text, "059")], "text string, file_id string")
    one, other = X.bulletin_meta(df).orderBy(F.col("file_id").asc_nulls_first()).collect()
    assert one["sitrep"] == number and other["sitrep"] == "059" and other["source_number_mismatch"] == number


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark):
    """Before, all pairs of all keys were made in the one task that read the points."""
    points = spark.range(600).select(F.when(F.col("id") < 500, 1).when(F.col("id") < 590, 2).alias("zone"), F.col("id").alias("p"), (F.col("id") * 0.5).alias("lon")).coalesce(1)
    pairs = G.pairs_within(points, "zone", "p", 64).withColumn("task", F.spark_partition_id())
    want = points.alias("a").join(points.alias("b"), F.expr("a.zone = b.zone AND a.p < b.p")).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    assert rows(pairs, "a", "b") == rows(want, "a", "b")
    most = pairs.groupBy("task").count().agg(F.max("count")).first()[0]
    assert most < pairs.count() / 6
    assert G.pairs_within(points.limit(0), "zone", "p").count() == 0
