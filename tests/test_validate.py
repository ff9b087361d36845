from pyspark.sql import functions as F

from driftwise.functions.payload import has_field, numeric_field
from driftwise.operators.normalize import normalize
from driftwise.operators.validate import (add_timestamp, dead_letter, drop_malformed, extract_numeric,
                                          parse_json_events, validate_schema)


def _raw(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


RAW = [
    '{"event_id":"a","source":"s","type":"t","timestamp":"2023-01-01T00:00:00Z","payload":{}}',
    '{"event_id":null,"source":"s","type":"t","timestamp":"2023-01-01T00:00:00","payload":{"x":1}}',
    '{"source":"s","type":"t","timestamp":"2023-01-01T00:00:00","payload":{"x":1}}',
    '{"event_id":"d","source":"s","type":"t","payload":{"x":1}}',
    '{"event_id":"e","source":"s","type":"t","timestamp":"2023-01-01T00:00:00"}',
    'not json',
]


def test_strict_presence_semantics(spark):
    out = parse_json_events(_raw(spark, RAW), strict=True).collect()
    # missing key fails; a present key with null value passes; bad JSON is dropped
    assert sorted((r.event_id or "<null>") for r in out) == ["<null>", "a"]


def test_lenient_fills_defaults(spark):
    out = parse_json_events(_raw(spark, RAW), strict=False).collect()
    assert len(out) == 5
    by = {r.source + str(i): r for i, r in enumerate(out)}
    assert all(r.event_id is not None or r.payload is not None for r in by.values())
    e = [r for r in out if r.event_id == "e"][0]
    assert e.payload == "{}" and e.meta == "{}"


def test_typed_validate(spark):
    df = spark.createDataFrame([("a", "s", "t", 1), (None, "s", "t", 2)], "event_id string, source string, type string, sec long")
    df = df.withColumn("timestamp", F.timestamp_seconds("sec")).withColumn("payload", F.lit("{}"))
    assert validate_schema(df).count() == 1
    assert validate_schema(df.drop("type")).count() == 0
    assert validate_schema(df, strict=False).filter("event_id is null").count() == 0


def test_drop_malformed_and_numeric(spark):
    df = spark.createDataFrame([(1, '{"price": 5, "q": "5"}'), (2, '{"price": null}'), (3, '{"q": 1}'),
                                (4, '{"price": true}'), (5, "bad")], "id long, payload string")
    kept = sorted(r.id for r in drop_malformed(df, ["price"]).collect())
    assert kept == [1, 2, 4]
    vals = {r.id: (r.p, r.q) for r in df.select("id", numeric_field(df, "price").alias("p"),
                                                 numeric_field(df, "q").alias("q")).collect()}
    assert vals[1] == (5.0, None)  # numeric text is not numeric
    assert vals[4] == (1.0, None)  # booleans are numbers
    assert vals[2] == (None, None)
    feats = extract_numeric(df, ["price", "q"]).select("id").collect()
    assert sorted(r.id for r in feats) == [1, 3, 4]
    dl = {r.id: r.reason for r in dead_letter(df.withColumn("event_id", F.lit("x")).withColumn("source", F.lit("s"))
                                              .withColumn("type", F.lit("t")).withColumn("timestamp", F.current_timestamp()),
                                              ["price"]).collect()}
    assert dl == {3: "missing_payload:price", 5: "missing_payload:price"}


def test_add_timestamp_meta(spark):
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "meta string")
    out = add_timestamp(df).collect()
    for r in out:
        assert '"processing_time":"' in r.meta and r.processing_time is not None
    assert out[1].meta.startswith('{"a":1,')


def test_struct_presence(spark):
    df = spark.createDataFrame([((1.0, None),)], "payload struct<price double, close double>")
    r = df.select(has_field(df, "close").alias("c"), has_field(df, "zzz").alias("z")).first()
    assert r.c is True and r.z is False


def test_json_payloads_are_decoded_once(spark):
    """F16: a number is taken by one parse of the text wherever it is tested, and rolling
    normalisation reads the rows of JSON payloads once for all its passes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return '{"price": %s}' % ("true" if i == 0 else '"5"' if i == 1 else "null" if i == 2 else i * 7 % 31)

    rows = spark.range(200).select(
        F.format_string("e%04d", "id").alias("event_id"), F.lit("s").alias("source"), F.lit("t").alias("type"),
        F.timestamp_seconds("id").alias("timestamp"), text("id").alias("payload"), F.lit("{}").alias("meta"))
    got = {r.event_id: r.price_normalized for r in normalize(rows, ["price"], window_size=5).collect()}
    assert seen.value == 200
    value = {i: 1.0 if i == 0 else float(i * 7 % 31) for i in range(200) if i not in (1, 2)}
    want, last = {}, []
    for i in range(200):
        last = (last + [value[i]])[-5:] if i in value else last
        spread = max(last) - min(last)
        want[f"e{i:04d}"] = (value[i] - min(last)) / spread if i in value and spread else None
    assert got == want
    plan = rows.filter(numeric_field(rows, "price").isNotNull())._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1
