"""Sessions of hot keys and on streams, chained bars, trading days, feedback, paced replay."""

import random

import pytest
from pyspark.sql import functions as F

from driftwise.extras.quality import per_trading_day, trading_days
from driftwise.extras.timeseries import bar_chain, sessions, sliding_counts
from driftwise.plans import rolling
from driftwise.sinks import read_table, submit_feedback, write_table
from driftwise.sources.replay import replay
from tests.conftest import events
from tests.test_sources_stream import _write_batches


def plain_sessions(rows, gap):
    out = {}
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] > gap:
                out.setdefault(key, []).append([t, t + gap, 0])
            out[key][-1][1:] = [t + gap, out[key][-1][2] + 1]
    return {(k, *s) for k, v in out.items() for s in v}


def found(df):
    return {(r.k, int(r.session_start.timestamp()), int(r.session_end.timestamp()), r.n) for r in df.collect()}


def test_sessions_of_a_hot_key_in_small_blocks(spark, monkeypatch):
    """Blocks of a few rows: sessions over several blocks, ties, null keys and null times."""
    monkeypatch.setattr(rolling, "LEAST_ROWS", 64)
    rng = random.Random(1)
    rows = [("hot", rng.randrange(6000)) for _ in range(900)] + [("long", 5 * i) for i in range(700)]
    rows += [(None, rng.randrange(400)) for _ in range(30)] + [("a", 7), ("a", 7), ("a", 17), ("a", 28), ("none", None)]
    df = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("timestamp"))
    assert found(sessions(df, "10 seconds", key=("k",))) == plain_sessions(rows, 10)
    assert sessions(df.limit(0), "10 seconds", key=("k",)).count() == 0


def test_windows_and_sessions_on_a_stream_with_a_late_row(spark, tmpdir_path):
    """Closed windows equal the table's; a row behind the watermark counts in neither."""
    rng = random.Random(2)
    rows = [(f"e{i:04d}", "s", "ab"[i % 2], i * 20 + rng.randrange(15), (float(i), 1.0, None)) for i in range(200)]
    df = events(spark, rows).select("event_id", F.col("type"), "timestamp", F.col("payload.price").alias("v"))
    src = f"{tmpdir_path}/in"
    _write_batches(spark, df, src, 4)
    late = events(spark, [("late", "s", "a", 5, (1e6, 1.0, None))]).select("event_id", "type", "timestamp", F.col("payload.price").alias("v"))
    end = events(spark, [("end", "s", "a", 50_000, (0.0, 1.0, None))]).select("event_id", "type", "timestamp", F.col("payload.price").alias("v"))

    builds = {"slide": lambda d: sliding_counts(d, "v", "2 minutes", "1 minute"), "gaps": lambda d: sessions(d, "35 seconds", key=("type",))}

    def run():  # each run goes on from the checkpoint of the one before
        for name, build in builds.items():
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("timestamp", "60 seconds")
            build(stream).writeStream.format("parquet").option("path", f"{tmpdir_path}/{name}").outputMode("append").option(
                "checkpointLocation", f"{tmpdir_path}/state-{name}").trigger(availableNow=True).start().awaitTermination()

    run()
    for more in (late, end):
        more.coalesce(1).write.mode("append").parquet(src)
        run()
    for name, build in builds.items():
        want = build(df)
        got = spark.read.parquet(f"{tmpdir_path}/{name}").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bar_chain_levels_and_multiples(spark):
    bars = spark.createDataFrame([("s", "t", 60 * i, float(i), float(i + 1), float(i - 1), float(i), 2.0, 3, f"e{i:02d}") for i in range(12)],
                                 "source string, type string, sec long, open double, high double, low double, close double, volume double, count long, event_id string")
    bars = bars.withColumn("window_start", F.timestamp_seconds("sec")).withColumn("timestamp", F.timestamp_seconds(F.col("sec") + 60)).drop("sec")
    out = bar_chain(bars, ["1m", "5m", "10m"]).orderBy("frequency", "window_start").collect()
    by = {f: [(r.open, r.high, r.low, r.close, r["count"]) for r in out if r.frequency == f] for f in ("1m", "5m", "10m")}
    assert len(by["1m"]) == 12
    assert by["5m"] == [(0.0, 5.0, -1.0, 4.0, 15), (5.0, 10.0, 4.0, 9.0, 15), (10.0, 12.0, 9.0, 11.0, 6)]
    assert by["10m"] == [(0.0, 10.0, -1.0, 9.0, 30), (10.0, 12.0, 9.0, 11.0, 6)]
    with pytest.raises(ValueError):
        bar_chain(bars, ["5m", "7m"])


def test_trading_days_in_a_zone_with_holidays(spark):
    df = spark.sql("""SELECT timestamp(t) AS timestamp FROM VALUES ('2024-03-07 16:30:00Z'), ('2024-03-08 15:00:00Z'),
                      ('2024-03-08 17:00:00Z'), ('2024-03-12 01:00:00Z'), (NULL) AS v(t)""")
    holidays = spark.createDataFrame([("2024-03-11",), (None,)], "day string")
    got = {str(r.day): r.n for r in per_trading_day(df, "timestamp", "Asia/Shanghai", holidays).collect()}
    assert got == {"2024-03-08": 2, "2024-03-12": 1}  # the 9th is a Saturday there
    got = {str(r.day): r.n for r in per_trading_day(df, "timestamp", "America/New_York").collect()}
    assert got == {"2024-03-07": 1, "2024-03-08": 2, "2024-03-11": 1}  # after the change to summer time
    assert trading_days(df.limit(0), "timestamp").count() == 0


def test_submitted_feedback_is_stored_once(spark, tmpdir_path):
    pats = spark.createDataFrame([(f"p{i}", "drift", "s", "{}", "[]") for i in range(3)],
                                 "pattern_id string, type string, source string, details string, contributors string"
                                 ).withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    fb = spark.createDataFrame([("p1", "u", 1, "ok"), ("p1", "u", 1, "ok"), ("p2", "u", 7, "bad"), ("zz", "u", 0, "x")],
                               "pattern_id string, user_id string, rating int, comment string")
    _, rejected = submit_feedback(spark, tmpdir_path, fb)
    assert {r.reason for r in rejected.collect()} == {"pattern_not_found", "invalid_rating"}
    write_table(pats, "pattern_events", tmpdir_path)
    given = fb.withColumn("timestamp", F.timestamp_seconds(F.lit(9)))
    first, rejected = submit_feedback(spark, tmpdir_path, given)
    again, _ = submit_feedback(spark, tmpdir_path, given)
    ids = {r.feedback_id for r in first.collect()}
    assert ids == {r.feedback_id for r in again.collect()} and len(ids) == 1 and rejected.count() == 2
    submit_feedback(spark, tmpdir_path, fb.filter("comment = 'ok'").limit(1))  # the time of submission
    stored = read_table(spark, "pattern_feedback", tmpdir_path).collect()
    assert len(stored) == 2 and ids < {r.feedback_id for r in stored}


def test_paced_replay_in_passes(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "k int")
    got = replay(df, "r", ["k"], epoch=100, rate=2.0, loops=2).orderBy("pass", "original_index").collect()
    assert [r.timestamp.timestamp() for r in got] == [100.0, 100.5, 101.0, 101.0, 101.5, 102.0]
    assert [r.event_id for r in got][:4] == ["replay-0-100", "replay-1-100", "replay-2-101", "replay-0-101"]
    for bad in ({"rate": 0.0}, {"loops": 0}):
        with pytest.raises(ValueError):
            replay(df, "r", ["k"], **bad)
