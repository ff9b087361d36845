from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwise.extras.timeseries import fuse, interval_join, interval_pairs, running
from tests.conftest import events


def test_fuse_aligns_sources_on_windows(spark):
    a = events(spark, [(f"a{i}", "a", "t", i * 30, (float(i), 1.0, None)) for i in range(8)])
    b = events(spark, [(f"b{i}", "b", "t", i * 60, (10.0 * i, 1.0, None)) for i in range(3)])
    out = fuse({"a": a.withColumn("price", F.col("payload.price")), "b": b.withColumn("price", F.col("payload.price"))},
               "2 minutes", "price").orderBy("window_start").collect()
    assert [(r.a__n, r.b__n) for r in out] == [(4, 2), (4, 1)]
    assert out[0].a__price == 1.5 and out[1].b__price == 20.0


def test_running_matches_cumulative_window(spark):
    rows = [(f"e{i:03d}", "s" if i % 3 else "u", "t", i, (float((i * 7) % 11), 1.0, None)) for i in range(200)]
    df = events(spark, rows).withColumn("v", F.col("payload.price"))
    got = {r.event_id: (r.running_sum, r.running_max) for r in
           running(running(df, "v", ["source"], ["timestamp", "event_id"], "sum"), "v", ["source"],
                   ["timestamp", "event_id"], "max").collect()}
    w = Window.partitionBy("source").orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.event_id: (r.s, r.m) for r in df.select("event_id", F.sum("v").over(w).alias("s"),
                                                      F.max("v").over(w).alias("m")).collect()}
    assert got == want


def test_interval_join_bounds(spark):
    left = spark.createDataFrame([("p", "s", 1000)], "pattern_id string, source string, sec long").withColumn(
        "timestamp", F.timestamp_seconds("sec")).drop("sec")
    right = events(spark, [(f"e{i}", "s", "t", 1000 + d, (0.0, 0.0, None)) for i, d in enumerate([-301, -300, 0, 300, 301])])
    got = sorted(r.offset_sec for r in interval_join(left, right, 300, 300).collect())
    assert got == [-300.0, 0.0, 300.0]


def test_interval_join_meets_few_pairs_out_of_range(spark):
    """of the pairs that meet in a bucket at most one in four is dropped again, and the
    result is that of a plain comparison, also at the edges and before 1970."""
    rows = [(f"e{i:04d}", "s" if i % 5 else "u", "t", i * 7 - 3000, (0.0, 0.0, None)) for i in range(1000)]
    right = events(spark, rows).select("event_id", "source", "timestamp")
    left = right.filter("source = 's' AND substring(event_id, 5, 1) = '3'").withColumnRenamed("event_id", "pattern_id")
    got = interval_join(left, right, 300, 301).select("pattern_id", "event_id", "offset_sec")
    met = interval_pairs(left, right, 300, 301, ("source",), "timestamp", "timestamp").count()
    sec = {e: s for e, _, _, s, _ in rows}
    src = {e: s for e, s, *_ in rows}
    want = {(p.pattern_id, e, float(sec[e] - sec[p.pattern_id])) for p in left.collect() for e in sec
            if src[e] == "s" and -300 <= sec[e] - sec[p.pattern_id] <= 301}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert met <= 1.35 * len(want)


def test_a_hot_time_of_an_interval_join_is_split(spark, monkeypatch):
    """tasks follow the pairs, not the input, and no task gets a hot bucket whole."""
    from driftwise.extras import timeseries

    monkeypatch.setattr(timeseries, "PAIRS", 2000, raising=False)
    monkeypatch.setattr(timeseries, "GROUP_ROWS", 60, raising=False)
    rows = [(f"e{i:04d}", None if i == 7 else "s", "t", 5000 + i % 9 if i < 400 else i * 50, (0.0, 0.0, None)) for i in range(500)]
    right = events(spark, rows).select("event_id", "source", "timestamp")
    left = right.filter("substring(event_id, 5, 1) = '3' OR event_id = 'e0007'").withColumnRenamed("event_id", "pattern_id")
    left, right = left.unionByName(left), right.unionByName(right.filter("event_id < 'e0100'"))
    got = interval_join(left, right, 300, 300).select("pattern_id", "event_id", "offset_sec")
    held = got.groupBy(F.spark_partition_id()).count().collect()
    sec = {r[0]: r[3] for r in rows if r[1]}
    near = sorted((p, e, float(sec[e] - sec[p])) for p in sec for e in sec for _ in range(4 if e < "e0100" else 2)
                  if p[4] == "3" and abs(sec[e] - sec[p]) <= 300)
    assert sorted(tuple(r) for r in got.collect()) == near
    assert len(held) > 4 and max(r["count"] for r in held) < len(near) / 3


def test_interval_join_meets_nan_keys(spark):
    rows = [("a", float("nan"), 10), ("b", float("nan"), 20), ("c", 1.0, 30), ("d", None, 40)]
    df = spark.createDataFrame(rows, "id string, k double, sec long").select("id", "k", F.timestamp_seconds("sec").alias("timestamp"))
    got = interval_join(df, df, 60, 60, on=("k",)).collect()
    assert sorted((r.id, r.r_id) for r in got) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
