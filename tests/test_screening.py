"""DDM with restart against the published method run row by row, factor selection, block
bootstrap, expiry of days, rejected file items."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from driftwise.extras import screening
from driftwise.extras.screening import bootstrap_return, ddm_restart, factor_correlations, factor_select
from driftwise.plans import rolling
from driftwise.sinks import expire, read_table, write_table
from driftwise.sources.files import read_csv_events, read_json_events, rejected_csv_rows, rejected_json_items
from tests.conftest import events


def sequential_ddm(errors, min_rows=30):
    n = e = segment = 0
    low, out = None, []
    for x in errors:
        n, e = n + 1, e + x
        p = e / n
        s = math.sqrt(p * (1 - p) / n)
        level = "normal"
        if n >= min_rows:
            low = min(low or (p + s, p, s), (p + s, p, s))
            level = "drift" if p + s > low[1] + 3 * low[2] else "warning" if p + s > low[1] + 2 * low[2] else "normal"
        out.append((pytest.approx(p), level, segment))
        if level == "drift":
            n = e = 0
            low, segment = None, segment + 1
    return out


def test_ddm_restarts_behind_every_drift(spark, monkeypatch):
    monkeypatch.setattr(rolling, "TARGET_ROWS", 90)
    rng = random.Random(3)
    rates = [0.05, 0.4, 0.9, 0.1, 0.7]
    series = {"a": [int(rng.random() < rates[i // 150]) for i in range(750)], "b": [0] * 60, None: [int(rng.random() < 0.2) for _ in range(50)]}
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)] + [("a", 10**6, None)]
    df = spark.createDataFrame(rows, "k string, o long, x int")
    got = {(r.k, r.o): (r.error_rate, r.level, r.segment) for r in ddm_restart(df, "x", ["k"], ["o"]).collect()}
    for k, xs in series.items():
        assert [got[k, i] for i in range(len(xs))] == sequential_ddm(xs)
    assert len(got) == len(rows) - 1 and max(s for _, _, s in got.values()) >= 2


def test_factor_selection(spark):
    rng = random.Random(4)
    rows = []
    for t in range(30):
        for _ in range(20):
            x, y = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((t, x, x + rng.gauss(0, 0.1), y, x + rng.gauss(0, 1), None))
    df = spark.createDataFrame(rows, "ts int, good double, twin double, noise double, fwd double, none double")
    got = {r.factor: (r.kept, r.rival) for r in factor_select(df, ["twin", "good", "noise", "none"], "fwd").collect()}
    best, other = (("good", "twin") if got["good"][0] else ("twin", "good"))
    assert got == {best: (True, None), other: (False, best), "noise": (True, None), "none": (True, None)}
    corr = {(r.a, r.b): r["corr"] for r in factor_correlations(df, ["good", "twin", "noise"]).collect()}
    assert len(corr) == 3 and corr["good", "twin"] > 0.98 > abs(corr["good", "noise"])


def test_block_bootstrap_of_a_return(spark):
    prices = [100.0]
    rng = random.Random(5)
    for _ in range(400):
        prices.append(prices[-1] * math.exp(rng.gauss(0.001, 0.01)))
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(prices)] + [("b", 0, 1.0), ("b", 1, 2.0), ("c", 0, 1.0)], "s string, o int, p double")
    got = {r.s: r for r in bootstrap_return(df, "p", ["s"], ["o"], block=20, draws=100).collect()}
    assert got["a"].total_return == pytest.approx(prices[-1] / prices[0] - 1) and got["a"].low < got["a"].total_return < got["a"].high
    assert (got["b"].n, got["b"].total_return, got["b"].low) == (1, pytest.approx(1.0), None) and "c" not in got
    flat = spark.createDataFrame([("a", i, math.exp(i / 10)) for i in range(101)], "s string, o int, p double")
    r = bootstrap_return(flat, "p", ["s"], ["o"], block=10, draws=20).first()
    assert r.low == pytest.approx(r.high) == pytest.approx(math.exp(10) - 1)


def test_old_days_go_and_live_days_stay(spark, tmpdir_path):
    rows = [(f"e{d}", "s", "t", d * 86400 + 5, (1.0, 1.0, None)) for d in range(40)]
    df = events(spark, rows).withColumn("payload", F.to_json("payload"))
    write_table(df, "raw_events", tmpdir_path)
    write_table(df, "clean_events", tmpdir_path, batch_id=0)
    write_table(df, "clean_events", tmpdir_path, batch_id=1)
    now = "1970-02-09 12:00:00"  # the 40th day
    for name, copies in (("raw_events", 1), ("clean_events", 2)):
        held = read_table(spark, name, tmpdir_path).filter("event_date >= '1970-02-09' AND event_id = 'e39'")  # opened before
        gone = expire(spark, tmpdir_path, name, 7, now)
        assert len(gone) == 33 * copies and expire(spark, tmpdir_path, name, 7, now) == []
        left = read_table(spark, name, tmpdir_path)
        assert {r.event_id for r in left.collect()} == {f"e{d}" for d in range(33, 40)} and held.count() == copies
    write_table(df.filter("event_id = 'e39'"), "raw_events", tmpdir_path)
    assert read_table(spark, "raw_events", tmpdir_path).count() == 8
    assert expire(spark, tmpdir_path, "no_such_table", 7, now) == []


def test_rejected_file_items(spark, tmpdir_path):
    def put(name, text):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)

    good = {"timestamp": "2024-01-01 00:00:00", "x": 1}
    put("a.json", json.dumps([good, {"timestamp": "yesterday"}, {"timestamp": 5}, {"x": 2}]))
    put("b.json", '{"cut off')
    put("c.json", "[]")
    put("d.json", json.dumps(good))
    got = {(os.path.basename(r.file), r.item, r.reason) for r in rejected_json_items(spark, tmpdir_path + "/*.json").collect()}
    assert got == {("a.json", 1, "bad_timestamp"), ("b.json", None, "bad_json"), ("c.json", None, "empty")}
    assert read_json_events(spark, tmpdir_path + "/*.json", "s").count() == 4
    put("e.csv", "timestamp,x\n2024-01-01 00:00:00,1\nnever,2\n,3\n")
    put("f.csv", "when,x\nnow,1\n")
    bad = rejected_csv_rows(spark, tmpdir_path + "/e.csv").collect()
    assert sorted((r.reason, json.loads(r.raw)["x"]) for r in bad) == [("bad_timestamp", "2"), ("no_timestamp", "3")]
    assert read_csv_events(spark, tmpdir_path + "/e.csv", "s").count() == 1
    assert rejected_csv_rows(spark, tmpdir_path + "/f.csv").count() == 0


def test_ddm_takes_a_fixed_number_of_jobs_and_carries_states_over_chunks(spark, monkeypatch):
    written = []
    monkeypatch.setattr(screening, "materialize", lambda df: written.append(1) or rolling.materialize(df))
    monkeypatch.setattr(screening, "DDM_CHUNK", 100)
    rng = random.Random(9)
    xs = [int(rng.random() < (0.05, 0.6)[i // 60 % 2]) for i in range(3000)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, o long, x int")
    got = {r.o: (r.error_rate, r.level, r.segment) for r in ddm_restart(df, "x", ["k"], ["o"]).collect()}
    assert [got[i] for i in range(len(xs))] == sequential_ddm(xs)
    assert got[len(xs) - 1][2] >= 10 and len(written) <= 3


def test_ddm_sends_no_table_of_rows_through_the_driver(spark):
    df = spark.createDataFrame([("a", i, i % 7 // 6) for i in range(500)], "k string, o long, x int")
    out = ddm_restart(df, "x", ["k"], ["o"])
    assert len(out.collect()) == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
