"""Histories in parts: what a crash leaves, what is read, what late reports change."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import history as H
from vigil.sources import parts as P
from vigil.streaming import ingest as I

DAY = datetime.date(2026, 7, 1)
SCHEMA = "k string, d date, v bigint"


def month():
    return F.date_format("d", "yyyy-MM")


def on(n):
    return DAY + datetime.timedelta(days=n)


def files(root):
    return {os.path.join(a, x) for a, _, b in os.walk(root) for x in b if x.endswith(".parquet")}


def held(spark, root):
    return sorted(map(tuple, I.current(spark, root, SCHEMA).collect()))


def put(spark, root, rows, number=None, writer="s"):
    return I.merge_batch(spark, spark.createDataFrame(rows, SCHEMA), root, SCHEMA, ["k", "d"], month(), (), writer, number)


def test_a_crash_before_the_switch_changes_nothing_and_the_batch_runs_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    put(spark, root, [("a", DAY, 1), ("b", on(40), 2)], 0)
    before = held(spark, root)

    def killed(*_):
        raise KeyboardInterrupt

    for at in ("staged", "switch"):  # before the new files are whole, and when they are but do not count yet
        with monkeypatch.context() as m:
            m.setattr(P, at, killed)
            with pytest.raises(KeyboardInterrupt):
                put(spark, root, [("a", DAY, 5), ("c", on(1), 3)], 1)
        assert held(spark, root) == before
    assert put(spark, root, [("a", DAY, 5), ("c", on(1), 3)], 1)
    assert held(spark, root) == [("a", DAY, 5), ("b", on(40), 2), ("c", on(1), 3)]


def test_a_batch_replayed_after_the_switch_is_known_by_its_number(spark, tmp_path):
    root = str(tmp_path / "history")
    assert put(spark, root, [("a", DAY, 1)], 7)
    now, at = files(root), P.manifest(spark, root)
    assert not put(spark, root, [("a", DAY, 99)], 7) and not put(spark, root, [("a", DAY, 99)], 3)
    assert files(root) == now and P.manifest(spark, root) == at and at.marks == {"s": 7}
    assert put(spark, root, [("a", DAY, 2)], 0, writer="other")  # numbers are each writer's own
    assert held(spark, root) == [("a", DAY, 2)] and P.manifest(spark, root).marks == {"s": 7, "other": 0}


def test_a_stream_killed_in_its_batch_loses_nothing(spark, tmp_path, monkeypatch):
    root, source, seen = (str(tmp_path / n) for n in ("history", "in", "seen"))
    run = lambda: I.ingest_stream(spark, source, SCHEMA, root, seen, ["k", "d"], month()).awaitTermination()
    spark.createDataFrame([("a", DAY, 1)], SCHEMA).write.mode("append").json(source)
    run()
    spark.createDataFrame([("a", DAY, 2), ("b", DAY, 3)], SCHEMA).coalesce(1).write.mode("append").json(source)
    with monkeypatch.context() as m:
        m.setattr(P, "switch", lambda *_: False)
        with pytest.raises(Exception, match="another writer"):
            run()
    assert held(spark, root) == [("a", DAY, 1)]
    run()
    assert held(spark, root) == [("a", DAY, 2), ("b", DAY, 3)]
    assert list(P.manifest(spark, root).marks.values()) == [1]


def test_parts_not_touched_are_neither_read_nor_written(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    put(spark, root, [("a", on(31 * n), n) for n in range(6)])
    old = P.manifest(spark, root)
    read = []
    real = P.rows
    monkeypatch.setattr(P, "rows", lambda *a: read.extend(a[5:]) or real(*a))
    put(spark, root, [("z", on(32), 1), (None, on(99), 1)])
    assert read == [["2026-08"]]
    new = P.manifest(spark, root)
    assert {p for p in new.parts("rows") if new.tables["rows"][p] != old.tables["rows"][p]} == {"2026-08"}
    assert len(held(spark, root)) == 7


def test_names_of_parts_and_empty_batches(spark, tmp_path):
    root = str(tmp_path / "history")
    names = ["a/b", "x=1 %", "", None, "é:?*", "none"]
    df = spark.createDataFrame([(n, DAY, i) for i, n in enumerate(names)], SCHEMA)
    made = P.staged(df, root, F.col("k"))
    assert set(made) == {"a/b", "x=1 %", "none", "é:?*"}
    at = P.commit(spark, root, P.Manifest(), {"t": made})
    assert P.rows(spark, root, at, "t", SCHEMA).count() == 6
    assert {r["v"] for r in P.rows(spark, root, at, "t", SCHEMA, ["none", "not there"]).collect()} == {2, 3, 5}
    assert P.staged(df.limit(0), root, F.col("k")) == {}
    assert P.manifest(spark, str(tmp_path / "nothing")) == P.Manifest() and I.current(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0
    put(spark, str(tmp_path / "empty"), [])
    assert held(spark, str(tmp_path / "empty")) == []


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "history")
    at = P.manifest(spark, root)
    P.commit(spark, root, at, {})
    with pytest.raises(RuntimeError, match="another writer"):
        P.commit(spark, root, at, {})


def test_vacuum_keeps_what_counts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    for n in range(4):
        put(spark, root, [("a", DAY, n), ("b", on(31 + n), n)])
    with monkeypatch.context() as m:
        m.setattr(P, "switch", lambda *_: False)
        with pytest.raises(RuntimeError):
            put(spark, root, [("lost", DAY, 1)])
    rows, many = held(spark, root), len(files(root))
    P.vacuum(spark, root, keep=1)
    assert held(spark, root) == rows and 0 < len(files(root)) < many
    used = {f for t in P.manifest(spark, root).tables.values() for f in t.values()}
    assert {os.path.relpath(os.path.dirname(f), root) for f in files(root)} == used
    put(spark, root, [("c", DAY, 1)])
    assert len(held(spark, root)) == len(rows) + 1


# --- late reports


def plain_carried(rows, begin):
    """(entity, date, value, carried) of every report date from `begin` on."""
    at = {(k, d): v for k, d, v in rows}
    out = set()
    for d in sorted({d for _, d, _ in rows}):
        for k in {k for k, x, _ in rows if x <= d}:
            last = max(x for n, x, _ in rows if n == k and x <= d)
            if d >= begin:
                out.add((k, d, at[k, last], last != d))
    return out


def test_late_reports_equal_the_whole_and_read_only_what_follows(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(3)
    root = str(tmp_path / "history")
    whole = {(k, on(n)): rng.randint(0, 99) for n in range(0, 200, 3) for k in "abcdef" if rng.random() < 0.4}
    late = [{("a", on(100)): 1000}, {("g", on(61)): 7, ("a", on(150)): 8}, {("b", on(2)): 5}, {("c", on(400)): 6}, {("d", on(199)): None}]
    read = []
    real = P.rows
    monkeypatch.setattr(P, "rows", lambda *a: read.append((a[3], *a[5:])) or real(*a))
    known = {}
    for batch in [whole, *late]:
        known |= batch
        read.clear()
        out = I.put_reports(spark, root, spark.createDataFrame([(*k, v) for k, v in batch.items()], SCHEMA), ["k"], ["v"])
        begin = min(d for _, d in batch)
        assert {(r["k"], r["d"], r["v"], r["carried"]) for r in out.collect()} == plain_carried([(*k, v) for k, v in known.items()], begin)
        first = begin.strftime("%Y-%m")
        (_, later), (_, before) = read
        assert all(p >= first for p in later) and len(before) <= 1 and all(p < first for p in before)
    assert sorted((r["k"], r["d"], r["v"]) for r in I.current(spark, root, SCHEMA).collect() if r["v"] is not None) == sorted((*k, v) for k, v in known.items() if v is not None)
    assert I.put_reports(spark, root, spark.createDataFrame([], SCHEMA), ["k"], ["v"]).count() == 0


def test_the_scan_of_a_late_report_lists_its_parts_only(spark, tmp_path):
    root = str(tmp_path / "history")
    I.put_reports(spark, root, spark.createDataFrame([("a", on(31 * n), n) for n in range(12)], SCHEMA), ["k"], ["v"])
    at = P.manifest(spark, root)
    later = P.rows(spark, root, at, "rows", SCHEMA, [p for p in at.parts("rows") if p >= "2027-04"])
    assert {f.split("_part=")[1].split("/")[0] for f in later.inputFiles()} == {p for p in at.parts("rows") if p >= "2027-04"}
    assert len(later.inputFiles()) < len(P.rows(spark, root, at, "rows", SCHEMA).inputFiles())
    assert at.parts("state") == at.parts("rows")


def test_carry_forward_between_reports(spark):
    """Observations on dates without a report are carried to the next one; keys keep apart."""
    rows = [("x", "a", on(0), 1), ("x", "a", on(3), 2), ("x", "b", on(2), 3), ("y", "a", on(9), 4)]
    df = spark.createDataFrame(rows, "o string, k string, d date, v bigint")
    reports = spark.createDataFrame([("x", on(1)), ("x", on(3)), ("x", on(5)), ("y", on(1)), ("y", on(9))], "o string, d date")
    out = {tuple(r) for r in H.carry_forward(df, reports, ["k"], ["v"], ["o"]).select("o", "k", "d", "v", "carried").collect()}
    assert out == {("x", "a", on(1), 1, True), ("x", "a", on(3), 2, False), ("x", "b", on(3), 3, True), ("x", "a", on(5), 2, True), ("x", "b", on(5), 3, True), ("y", "a", on(9), 4, False)}
    spans = {(r["o"], r["k"], r["valid_from"], r["valid_until"]) for r in H.validity(df, ["k"], ["v"], ["o"]).collect()}
    assert spans == {("x", "a", on(0), on(3)), ("x", "a", on(3), None), ("x", "b", on(2), None), ("y", "a", on(9), None)}
    plan = H.carry_forward(df.drop("o"), reports.select("d"), ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_equal_buckets_are_not_joined(spark):
    old = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
    new = old.where("k <> 'k5'").withColumn("v", F.when(F.col("k") == "k70", 1).when(F.col("k") != "k71", F.col("v"))).unionByName(spark.createDataFrame([("new", None)], "k string, v bigint"))
    assert {tuple(r) for r in H.diff_versions(old, new, ["k"], "v").select("k", "old_value", "new_value", "change").collect()} == {("k5", 5, None, "removed"), ("k70", None, 1, "changed"), ("k71", 71, None, "changed"), ("new", None, None, "added")}
    differ = H.differing_buckets(old, new, ["k"], "v")
    assert differ.count() == 4
    joined = old.withColumn("_bucket", H._bucket(["k"], 4096)).join(differ, "_bucket", "left_semi")
    assert joined.count() < 60  # of 20,000
    assert H.differing_buckets(old, old.orderBy(F.desc("k")), ["k"], "v").count() == 0
