"""Tables, exports and the staged stream: retries, batches against one run, late rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from driftwise.operators import validate
from driftwise.operators.bars import aggregate, flatten_bars
from driftwise.operators.normalize import normalize
from driftwise.plans.chain import Pipeline
from driftwise.plans.engine import PatternEngine
from driftwise.schema import TABLES, create_tables
from driftwise.sinks import batch_router, export, read_table, write_table
from driftwise.sources.files import stream_files
from driftwise.sources.parsers import PARSERS, get_parser
from driftwise.streaming.rolling import stream_normalize
from driftwise.streaming.run import run_stages, stream_bars
from tests.conftest import events
from tests.test_sources_stream import _write_batches

CLEAN = {"preprocessing": {"default": [{"name": "validate_schema"}]}}
DETECT = {"detectors": [
    {"name": "d", "type": "adwin", "source": "s", "config": {"fields": ["price"], "method": "adjacent", "frame": 20, "grace_period": 40}},
    {"name": "c", "type": "cluster_detector", "source": "s",
     "config": {"features": ["price"], "centroids": [[0.0], [50.0]], "window_size": 10}},
    {"name": "h", "type": "half_space_trees", "source": "s", "config": {"fields": ["price"], "window_size": 50}}]}


def shifted(spark, n=240):
    rows = [(f"e{i:04d}", "s", "t", i, ((0.0 if i < n // 2 else 50.0) + i % 3, 1.0, None)) for i in range(n)]
    df = events(spark, rows)
    return df.withColumn("payload", F.to_json("payload"))


def test_two_batches_equal_one_run(spark, tmpdir_path):
    df = shifted(spark)
    path, base = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "tables")
    _write_batches(spark, df, path, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    engine = PatternEngine(DETECT)
    q = run_stages(stream, base, os.path.join(tmpdir_path, "ck"), Pipeline(CLEAN), engine, {"availableNow": True})
    q.awaitTermination()
    assert read_table(spark, "raw_events", base).count() == 240
    got = {(r.pattern_id, r.type) for r in read_table(spark, "pattern_events", base).collect()}
    want = engine.detect(df).collect()
    assert got == {(r.pattern_id, r.type) for r in want}
    assert {r.detector_type for r in want} == {"adwin", "cluster_detector", "half_space_trees"}
    days = [d for d in os.listdir(f"{base}/raw_events/batch_id=0") if d.startswith("event_date")]
    files = [f for f in os.listdir(f"{base}/raw_events/batch_id=0/{days[0]}") if f.endswith(".parquet")]
    assert len(files) == 1


def test_a_retried_batch_replaces_itself(spark, tmpdir_path):
    route = batch_router(tmpdir_path, Pipeline(CLEAN).transform)
    df = shifted(spark, 50)
    for epoch in (0, 0, 1, 0):
        route(df, epoch)
    assert read_table(spark, "raw_events", tmpdir_path).count() == 100
    assert read_table(spark, "clean_events", tmpdir_path).count() == 100


def test_tables_and_exports(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "db")
    paths = create_tables(spark, base)
    assert set(paths) == set(TABLES) and create_tables(spark, base) == paths
    df = shifted(spark, 20)
    write_table(df, "raw_events", base)
    write_table(df, "raw_events", base)
    back = read_table(spark, "raw_events", base)
    assert back.count() == 40 and "ingest_time" in back.columns and back.filter("ingest_time is null").count() == 0
    with pytest.raises(ValueError):
        write_table(df, "no_such_table", base)
    nested = df.select("event_id", F.struct("source", "type").alias("s"))
    where = export(nested, os.path.join(tmpdir_path, "j"), "json")
    assert spark.read.json(where).count() == 20
    where = export(nested, os.path.join(tmpdir_path, "c"), "csv")
    row = spark.read.option("header", True).option("escape", '"').csv(where).first()
    assert json.loads(row.s) == {"source": "s", "type": "t"}
    with pytest.raises(ValueError):
        export(df, base, "xml")
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_stream_files_reads_new_files_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "files")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        json.dump([{"x": 1}, {"x": 2, "timestamp": "2024-01-01 00:00:00"}], f)

    out = os.path.join(tmpdir_path, "out")

    def run():
        q = (stream_files(spark, src, "json", "files").writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", os.path.join(tmpdir_path, "ckf")).trigger(availableNow=True).start(out))
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 2
    with open(os.path.join(src, "b.json"), "w") as f:
        json.dump({"x": 3}, f)
    assert run() == 3 and run() == 3
    with pytest.raises(ValueError):
        stream_files(spark, src, "csv", "files")


def test_stream_normalize_equals_batch(spark, tmpdir_path):
    rows = [(f"e{i:04d}", "s", "t", i, (None if i % 11 == 3 else float((i * 7) % 13), 1.0, None)) for i in range(90)]
    df = events(spark, rows).drop("meta")
    path = os.path.join(tmpdir_path, "in")
    _write_batches(spark, df, path, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for method in ("min_max", "z_score"):
        q = (stream_normalize(stream, "price", method, 10).writeStream.format("memory").queryName(f"norm_{method}")
             .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, f"ck{method}"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        got = {r.event_id: r.price_normalized for r in spark.sql(f"select * from norm_{method}").collect()}
        want = {r.event_id: r.price_normalized for r in normalize(df, ["price"], method, 10).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (v is None and got[k] is None) or got[k] == pytest.approx(v, abs=1e-9), (method, k)


def test_stream_bars_equal_batch_and_late_rows_are_left_out(spark, tmpdir_path):
    rows = [(f"e{i:04d}", "s", "t", i * 5, (float(i % 7), 1.0, None)) for i in range(200)]
    late = events(spark, [("late", "s", "t", 1, (99.0, 1.0, None))])
    df = events(spark, rows)
    path = os.path.join(tmpdir_path, "in")
    _write_batches(spark, df, path, 2)
    late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = (stream_bars(stream, window="1m", watermark="10 seconds").writeStream.format("memory").queryName("bars_late")
         .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    bars = lambda x: {(str(r.timestamp), r.high, r["count"]) for r in x.collect()}
    got = bars(flatten_bars(spark.sql("select * from bars_late")))
    want = bars(flatten_bars(aggregate(df, window="1m")))
    assert got < want and len(want - got) <= 1  # the last window is still open; no bar has the late row


def test_rejects_and_registry(spark):
    texts = ['{"event_id":"1","source":"s","type":null,"timestamp":"2024-01-01T00:00:00Z","payload":{}}', '{"event_id"', "[1]",
             None, '{"source":"s","type":"t","timestamp":"2024-01-01T00:00:00Z","payload":{}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = {r.i: r.reason for r in validate.reject_json_events(df).collect()}
    assert got == {1: "bad_json", 2: "not_an_object", 3: "bad_json", 4: "missing:event_id"}
    assert validate.parse_json_events(df).count() == 1
    assert get_parser("json_parser") is PARSERS["json_parser"]
    with pytest.raises(ValueError):
        get_parser("nope")


def test_stamping_twice_keeps_types(spark):
    df = spark.createDataFrame([('{"a":1,"b":true,"c":[1,2]}',), ("{}",), (None,)], "meta string")
    out = validate.add_timestamp(validate.add_timestamp(df.withColumn("payload", F.lit("{}"))))
    got = [json.loads(r.meta) for r in out.collect()]
    assert {k: got[0][k] for k in "abc"} == {"a": 1, "b": True, "c": [1, 2]}
    assert all("processing_time" in g for g in got) and set(got[1]) == {"processing_time"}


def test_rows_with_null_keys_stay(spark):
    from driftwise.detectors.hst import scale_by_key
    from driftwise.extras.crosssection import cs_zscore, neutralize
    from driftwise.extras.quality import iqr_filter

    df = spark.createDataFrame([(None, "g", 1.0), (None, None, 2.0), ("t", "g", 3.0), ("t", "g", 4.0), ("t", None, 5.0)],
                               "ts string, grp string, x double")
    assert cs_zscore(df, "x").count() == 5 and neutralize(df, "x", "grp").count() == 5
    assert iqr_filter(df, "x", ["ts"], 10.0).count() == 5
    ev = events(spark, [("a", None, "t", 1, (1.0, 1.0, None)), ("b", "s", "t", 2, (2.0, 1.0, None))])
    assert scale_by_key(ev, ["price"]).count() == 2


def test_exact_quantiles(spark):
    from driftwise.functions.quantiles import exact_quantiles

    rows = [("a", float(i * i % 97)) for i in range(500)] + [("b", 5.0)] * 9 + [(None, 1.0), (None, 2.0), ("c", None)]
    rows += [("d", v) for v in (1e-300, 1e300, -1e300, 0.0, 1e-5)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.k: r._q for r in exact_quantiles(df, ["k"], "x", probs).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert got[k] is q is None or got[k] == pytest.approx(q, rel=1e-12), k


def test_hot_key_stays_below_the_target(spark, monkeypatch):
    """One key over many blocks, text order column included: no window group is larger
    than the target allows."""
    from driftwise.plans import rolling

    monkeypatch.setattr(rolling, "TARGET_ROWS", 100)
    df = spark.range(1000).select(F.lit("k").alias("key"), F.format_string("%05d", "id").alias("o"), "id")
    got = rolling.over_rows(df, ["key"], ["o"], 5, lambda fr: [
        F.sum("id").over(fr.rows(6)).alias("s"), F.count("id").over(fr.w.rowsBetween(-10_000, 10_000)).alias("group")])
    rows = got.orderBy("id").collect()
    assert [r.s for r in rows] == [sum(range(max(0, i - 5), i + 1)) for i in range(1000)]
    assert max(r.group for r in rows) <= 105
    chunks = rolling.index_within_key(df, ["key"], ["o"]).groupBy("_chunk").count().collect()
    assert len(chunks) >= 8 and max(r["count"] for r in chunks) <= 400
