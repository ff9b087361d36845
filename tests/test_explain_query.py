import json

from pyspark.sql import functions as F

from driftwise.detectors.explain import explain, fmt2
from driftwise.plans.monitor import feedback_labels, latency_histogram, latency_stats, status_rollup
from driftwise.plans.query import accept_feedback, query_events, short_view


def _patterns(spark, rows):
    df = spark.createDataFrame(rows, "pattern_id string, type string, sec long, source string, details string, contributors string")
    return df.withColumn("timestamp", F.timestamp_seconds("sec")).drop("sec")


DRIFT = json.dumps({"detector": "test-detector", "confidence": 0.95, "price_prev_mean": 100.0,
                    "price_new_mean": 110.0, "price_change_pct": 10.0})


def test_drift_text(spark):
    df = _patterns(spark, [("p1", "drift", 1672531200, "test-source", DRIFT, '[{"field":"price","score":1.0}]')])
    text = explain(df).first().explanation
    assert text == ("在 2023-01-01 00:00:00 检测到概念漂移，来源于 test-source。 price 从 100.00 增加到 110.00，"
                    "变化率 10.00%。 主要贡献因子: price (1.00)。 置信度: 0.95。")


def test_other_types_and_defaults(spark):
    rows = [
        ("p2", "anomaly", 0, "s", '{"score":0.97,"threshold":0.9,"confidence":0.7}',
         '[{"field":"a","score":0.2},{"field":"b","score":0.5},{"field":"c","score":0.5},{"field":"d","score":0.1}]'),
        ("p3", "cluster_change", 0, "s", '{"prev_cluster":1,"new_cluster":2,"confidence":0.4}', "[]"),
        ("p4", "weird", 0, "s", None, None),
        ("p5", "drift", 0, "s", "not json", "[]"),
    ]
    got = {r.pattern_id: r.explanation for r in explain(_patterns(spark, rows)).collect()}
    assert got["p2"].endswith("异常分数 0.97，超过阈值 0.90。 主要贡献因子: b (0.50), c (0.50), a (0.20)。 置信度: 0.70。")
    assert got["p3"].endswith("聚类从 1 变化到 2。 置信度: 0.40。")
    assert got["p4"] == "在 1970-01-01 00:00:00 检测到未知模式类型 weird，来源于 s。"
    assert got["p5"].endswith("来源于 s。 置信度: 0.00。")


def test_fmt2_matches_python(spark):
    vals = [0.995, 0.125, 2.675, -0.001, 1.005, 10.0, 123.456, 0.375]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(fmt2(F.col("x"))).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def test_query_and_feedback(spark):
    pats = _patterns(spark, [(f"p{i}", "drift", i, "s" if i % 2 else "t", "{}", "[]") for i in range(10)])
    got = [r.pattern_id for r in query_events(pats, source="s", start="1970-01-01 00:00:03", limit=2).collect()]
    assert got == ["p9", "p7"]
    try:
        query_events(pats, limit=0)
        raise AssertionError("limit 0 accepted")
    except ValueError:
        pass
    fb = spark.createDataFrame([("p1", "u", 1, "ok"), ("p1", "u", 5, "bad"), ("zz", "u", 0, "x")],
                               "pattern_id string, user_id string, rating int, comment string")
    fb = fb.withColumn("timestamp", F.current_timestamp())
    acc, rej = accept_feedback(fb, pats)
    assert acc.count() == 1
    assert sorted(r.reason for r in rej.collect()) == ["invalid_rating", "pattern_not_found"]
    assert {r.label: r["count"] for r in feedback_labels(acc).collect()} == {"positive": 1}
    sv = short_view(explain(pats)).first()
    assert sv.short_id.endswith("...") and sv.confidence_pct == "50%" and len(sv.short_explanation) <= 53


def test_monitor(spark):
    df = spark.createDataFrame([("a", 0.002), ("a", 0.2), ("b", 7.0)], "k string, lat double")
    h = {r.k: r for r in latency_histogram(df, "lat", ["k"]).collect()}
    assert h["a"]["le_0.005"] == 1 and h["a"]["le_0.5"] == 2 and h["b"]["le_5"] == 0 and h["b"]["count"] == 1
    s = latency_stats(df, "lat").first()
    assert s["count"] == 3 and abs(s.median - 0.2) < 1e-12
    st = spark.createDataFrame([("x", "healthy"), ("x", "unknown"), ("y", "healthy"), ("z", "unhealthy"),
                                ("z", "unknown")], "c string, status string")
    assert {r.c: r.status for r in status_rollup(st, "status", ["c"]).collect()} == {
        "x": "unknown", "y": "healthy", "z": "unhealthy"}
