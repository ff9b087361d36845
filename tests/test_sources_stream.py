import json
import os
import time

from pyspark.sql import functions as F

from driftwise.operators.features import extract_features
from driftwise.sources.files import read_csv_events, read_json_events
from driftwise.sources.messages import parse_chart, parse_trades
from driftwise.sources.replay import replay, synthetic_wave
from driftwise.streaming import stream_adwin, stream_bars, stream_features
from driftwise.plans.chain import Pipeline
from driftwise.plans.engine import PatternEngine
from tests.conftest import events


def test_csv_and_json_files(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    with open(p, "w") as f:
        f.write("timestamp,price\n2024-01-01 00:00:01,5\nbad-time,6\n2024-01-01 00:00:03,7\n")
    ev = read_csv_events(spark, p, "local_csv").collect()
    assert len(ev) == 2 and ev[0].type == "file_data" and json.loads(ev[0].payload)["price"] in ("5", "7")
    q = os.path.join(tmpdir_path, "nohdr.csv")
    with open(q, "w") as f:
        f.write("1,2\n3,4\n")
    nh = read_csv_events(spark, q, "x", header=False).collect()
    assert sorted(json.loads(r.payload)["field_1"] for r in nh) == ["2", "4"]
    j = os.path.join(tmpdir_path, "j")
    os.makedirs(j)
    with open(os.path.join(j, "arr.json"), "w") as f:
        json.dump([{"timestamp": "2024-01-01 00:00:00", "v": 1}, {"timestamp": 1704067200, "v": 2}, {"v": 3}], f)
    with open(os.path.join(j, "obj.json"), "w") as f:
        json.dump({"timestamp": "2024-01-02 00:00:00", "v": 4}, f)
    js = read_json_events(spark, j, "files").collect()
    assert sorted(json.loads(r.payload)["v"] for r in js) == [1, 2, 3, 4]


def test_trade_and_chart_parsers(spark):
    msgs = spark.createDataFrame([
        ('{"s":"BTC","p":"100.5","q":"2","T":1700000000000,"m":true}',),
        ('{"s":"BTC","p":"x","q":"2","T":1700000000000,"m":true}',),
        ('{"s":"BTC","q":"2","T":1700000000000,"m":false}',),
        ('{"s":"ETH","p":3,"q":1.5,"T":1700000001000,"m":false}',),
    ], "value string")
    got = parse_trades(msgs).select("payload.*").collect()
    assert [(r.symbol, r.price, r.quantity, r.side) for r in got] == [("BTC", 100.5, 2.0, "buy"), ("ETH", 3.0, 1.5, "sell")]
    chart = {"chart": {"result": [{"meta": {"symbol": "AAPL"}, "timestamp": [1, 2],
                                   "indicators": {"quote": [{"open": [1.0, 2.0], "high": [1.5, 2.5], "low": [0.5, 1.5],
                                                             "close": [1.2, 2.2], "volume": [10, 20]}]}}]}}
    empty = {"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [], "indicators": {"quote": [{}]}}]}}
    df = spark.createDataFrame([(json.dumps(chart),), (json.dumps(empty),)], "value string")
    last = parse_chart(df).select("payload.*").collect()
    assert len(last) == 1 and last[0].close == 2.2 and last[0].volume == 20
    assert parse_chart(df, latest_only=False).count() == 2


def test_trade_messages_are_parsed_once(spark):
    """the tests of a message may not each parse it anew; absent, null and odd values as before."""
    good = {"s": "A", "p": "1.5", "q": 2, "T": 1700000000000, "m": True}
    odd = [{}, {"s": None}, {"m": None}, {"m": "no bool"}, {"p": True}, {"p": None}, {"q": "x"}, {"T": "1700000000001"}, {"T": None}]
    texts = [json.dumps({**good, **o}) for o in odd] + [json.dumps({k: v for k, v in good.items() if k != d}) for d in good]
    msgs = spark.createDataFrame([(t,) for t in [*texts, "{cut", "[1]", None]], "value string")
    out = parse_trades(msgs)
    got = sorted((str(r.symbol), r.price, r.side, r.ms) for r in out.select("payload.*", F.unix_millis("timestamp").alias("ms")).collect())
    t = 1700000000000
    assert got == sorted([("A", 1.5, "buy", t), ("None", 1.5, "buy", t), ("A", 1.5, "sell", t), ("A", 1.5, "sell", t),
                          ("A", 1.0, "buy", t), ("A", 1.5, "buy", t + 1)])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") <= 1


def test_replay_index(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    got = [(r.original_index, json.loads(r.payload)["v"]) for r in replay(df, "r", ["k"], epoch=7).orderBy("original_index").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "c")]
    w = synthetic_wave(spark, 12).select("payload.*").collect()
    assert [r.price for r in w[:3]] == [100, 110, 120] and w[5].volume == 1000


def _write_batches(spark, df, path, n):
    pdf = df.toPandas().sort_values(["timestamp", "event_id"])
    size = -(-len(pdf) // n)
    for i in range(n):
        part = pdf.iloc[i * size:(i + 1) * size]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def test_stream_equals_batch(spark, tmpdir_path):
    rows = [(f"e{i:04d}", "s", "t", i * 10, (None, None, float((i * 7) % 13))) for i in range(120)]
    df = events(spark, rows).drop("meta")
    path = os.path.join(tmpdir_path, "in")
    _write_batches(spark, df, path, 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    feats = ["sma_5", "ema_3", "rsi_4"]
    q = (stream_features(stream, feats, window_size=20).writeStream.format("memory").queryName("sf_out")
         .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.event_id: r for r in spark.sql("select * from sf_out").collect()}
    want = {r.event_id: r for r in extract_features(df, feats, window_size=20).collect()}
    assert got.keys() == want.keys()
    for k in want:
        for f in feats:
            a, b = got[k][f], want[k][f]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (k, f, a, b)


def test_stream_bars_and_adwin(spark, tmpdir_path):
    vals = [0.0] * 400 + [5.0] * 400
    rows = [(f"e{i:04d}", "s", "t", i, (v, 1.0, None)) for i, v in enumerate(vals)]
    df = events(spark, rows).drop("meta")
    path = os.path.join(tmpdir_path, "in2")
    _write_batches(spark, df, path, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    qb = (stream_bars(stream.withColumn("meta", F.lit("{}")), window="1m", watermark="0 seconds")
          .writeStream.format("memory").queryName("bars_out").outputMode("append")
          .option("checkpointLocation", os.path.join(tmpdir_path, "ckb")).trigger(availableNow=True).start())
    qb.awaitTermination()
    assert spark.sql("select * from bars_out").count() >= 10
    qa = (stream_adwin(stream, "price").writeStream.format("memory").queryName("adwin_out").outputMode("append")
          .option("checkpointLocation", os.path.join(tmpdir_path, "cka")).trigger(availableNow=True).start())
    qa.awaitTermination()
    hits = [int(r.event_id[1:]) for r in spark.sql("select * from adwin_out").collect()]
    assert hits and min(hits) >= 400


def test_chain_and_engine(spark):
    rows = [(f"e{i:04d}", "a" if i % 2 else "b", "t", i, (float(i % 5), 1.0, None)) for i in range(300)]
    df = events(spark, rows)
    cfg = {"preprocessing": {"default": [{"name": "validate_schema"}, {"name": "unknown_op"}],
                             "pipelines": [{"source": "a", "operators": [{"name": "normalize_price",
                                                                          "config": {"fields": ["price"]}}]}]}}
    out = Pipeline(cfg).transform(df)
    assert out.count() == 300 and out.filter("price_normalized is not null").count() > 0
    eng = PatternEngine({"detectors": [
        {"name": "d", "type": "adwin", "source": "a", "config": {"fields": ["price"], "method": "adjacent"}},
        {"name": "c", "type": "cluster_detector", "source": "b",
         "config": {"features": ["price"], "centroids": [[0.0], [4.0]], "window_size": 10}},
        {"name": "x", "type": "nope", "source": "a", "config": {}}]})
    pats = eng.detect(df)
    assert set(pats.columns) >= {"pattern_id", "type", "detector_type", "details", "contributors"}
    pats.count()
