"""Message-feed parsers (trade ticks, quote charts) and topic subscription.

Parsers are DataFrame -> DataFrame over a text column holding one message per
row, so they run unchanged on Kafka / file / socket streams and batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .envelope import to_envelope


def _get(col: str, path: str, dtype: str):
    return F.expr(f"try_variant_get(`{col}`, '{path}', '{dtype}')")


def _has(col: str, path: str):
    return F.expr(f"variant_get(`{col}`, '{path}')").isNotNull()


def parse_trades(df: DataFrame, value_col: str = "value", source: str = "trades") -> DataFrame:
    """Trade tick ``{s, p, q, T (ms), m}`` -> event type ``trade`` with payload
    {symbol, price, quantity, side = buy if m else sell}; a message missing any
    key, or with a price / quantity that is not a number, is dropped."""
    value = "_message"
    # p, q and T are there when they give a number
    read = F.struct(
        (_has(value, "$.s") & _has(value, "$.m")).alias("present"),
        _get(value, "$.s", "string").alias("symbol"), _get(value, "$.p", "double").alias("price"),
        _get(value, "$.q", "double").alias("quantity"), _get(value, "$.T", "double").alias("ms"),
        _get(value, "$.m", "boolean").alias("buy"))
    # the tests below would be pushed down to the text, which each of them would parse
    # anew; they cannot be pushed through a generator, so a message is parsed once
    rows = df.withColumn(value, F.try_parse_json(F.col(value_col))).withColumn("_trade", F.explode(F.array(read)))
    t = "_trade."
    rows = rows.filter(F.col(t + "present") & F.col(t + "price").isNotNull() & F.col(t + "quantity").isNotNull()
                       & F.col(t + "ms").isNotNull())
    payload = {
        "symbol": F.col(t + "symbol"),
        "price": F.col(t + "price"),
        "quantity": F.col(t + "quantity"),
        "side": F.when(F.coalesce(F.col(t + "buy"), F.lit(False)), F.lit("buy")).otherwise(F.lit("sell")),
    }
    ts = F.timestamp_millis(F.col(t + "ms").cast("long"))
    return to_envelope(rows, source, "trade", timestamp=ts, payload=payload)


CHART_SCHEMA = ("struct<chart:struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<long>,"
                "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,"
                "close:array<double>,volume:array<long>>>>>>>>")


def parse_chart(df: DataFrame, value_col: str = "value", source: str = "chart", latest_only: bool = True) -> DataFrame:
    """Quote-chart JSON -> event type ``price``: the newest bar (last element of
    every array) or, with ``latest_only=False``, every bar. No timestamps or no
    quote -> no event."""
    c = F.from_json(F.col(value_col), CHART_SCHEMA)
    res = c["chart"]["result"][0]
    q = res["indicators"]["quote"][0]
    base = df.select(res["meta"]["symbol"].alias("symbol"), res["timestamp"].alias("ts"), q.alias("q")).filter(
        (F.size("ts") > 0) & F.col("q").isNotNull())
    if latest_only:
        pick = {f: F.element_at(F.col(f"q.{f}"), -1) for f in ("open", "high", "low", "close", "volume")}
        rows = base.select("symbol", F.element_at("ts", -1).alias("_t"), *[v.alias(k) for k, v in pick.items()])
    else:
        z = F.arrays_zip(F.col("ts").alias("t"), F.col("q.open").alias("open"), F.col("q.high").alias("high"),
                         F.col("q.low").alias("low"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"))
        rows = base.select("symbol", F.explode(z).alias("b")).select(
            "symbol", F.col("b.t").alias("_t"), *[F.col(f"b.{f}").alias(f) for f in ("open", "high", "low", "close", "volume")])
    payload = {k: F.col(k) for k in ("symbol", "open", "high", "low", "close", "volume")}
    return to_envelope(rows, source, "price", timestamp=F.timestamp_seconds("_t"), payload=payload)


def subscribe(spark: SparkSession, servers: str, pattern: str = r"events\..*", starting: str = "latest",
              max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Streaming subscription to every topic matching ``pattern`` (message value
    as text, topic kept). Needs the Kafka connector on the classpath."""
    rs = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
          .option("subscribePattern", pattern).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        rs = rs.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return rs.load().select(F.col("value").cast("string").alias("value"), "topic", "timestamp")
