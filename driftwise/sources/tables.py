"""Adapters from the driver's Parquet tables to the event envelope.

Only the columns an envelope needs are selected, so the Parquet scan reads a
pruned schema. ``TIMESTAMP_NTZ`` columns are cast to ``TIMESTAMP`` (UTC session),
which streaming watermarks require.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_utc

ADAPTER_META = '{"adapter_version":"1.0"}'

# Tie-break order of lineitem rows: l_shipdate repeats heavily and
# (l_orderkey, l_linenumber) is not unique, so the full tuple orders them.
LINEITEM_ORDER = [
    "timestamp", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> envelope: source ``events``, type = event_type,
    payload {price: value, quantity: props.k, user_id}. Order key (timestamp, event_id)."""
    ensure_utc(spark)
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit("events").alias("source"),
        F.col("event_type").alias("type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.struct(
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").try_cast("long").alias("quantity"),
            F.col("user_id").alias("user_id"),
        ).alias("payload"),
        F.lit(ADAPTER_META).alias("meta"),
    )


def events_raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> envelope whose payload is the JSON text in ``props``
    (schemaless at-rest form; fields are tested by key presence and JSON type)."""
    ensure_utc(spark)
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit("events").alias("source"),
        F.col("event_type").alias("type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("props").alias("payload"),
        F.lit(ADAPTER_META).alias("meta"),
    )


def lineitem_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` -> envelope: source ``lineitem``, type = l_returnflag,
    payload {price: l_extendedprice, quantity: l_quantity}; keeps the tie-break keys."""
    ensure_utc(spark)
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
        F.lit("lineitem").alias("source"),
        F.col("l_returnflag").alias("type"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.struct(
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("quantity"),
        ).alias("payload"),
        F.lit(ADAPTER_META).alias("meta"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )


SHIFT_AT = "2024-01-16 00:00:00"
SHIFT = {"price": 300.0, "quantity": 200}


def events_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events_envelope`` with a level shift from ``SHIFT_AT`` on: input for drift detectors."""
    ev = events_envelope(spark, sf_dir)
    late = F.col("timestamp") >= F.lit(SHIFT_AT).cast("timestamp")
    payload = F.col("payload")
    for name, step in SHIFT.items():
        payload = payload.withField(name, F.col(f"payload.{name}") + F.when(late, F.lit(step)).otherwise(F.lit(step * 0)))
    return ev.withColumn("payload", payload)


def events_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event JSON text with faults by id: cut-off text, an absent key, a null value and
    values of other types, as a feed may send them."""
    ev = table(spark, sf_dir, "events")
    ident = F.col("event_id")
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [
        F.when(ident % 7 != 1, member("event_id", quoted(ident.cast("string")))),
        member("source", F.lit('"feed"')),
        F.when(ident % 7 != 2, member("type", F.when(ident % 11 == 0, F.lit("null")).otherwise(quoted(F.col("event_type"))))),
        F.when(ident % 7 != 3, member("timestamp", quoted(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")))),
        F.when(ident % 7 != 4, member("payload", F.col("props"))),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    cut = F.substring(text, 1, 20)
    return ev.select(ident.alias("row"), F.when(ident % 13 == 5, cut).otherwise(text).alias("value"))
