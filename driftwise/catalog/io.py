"""Catalog: feed parsers, replay, config-driven preprocessing over mixed sources.

Stand-in inputs are built from the driver tables only as *messages in the
shape a feed delivers* (JSON text); the parsers do all the work on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.payload import payload_json
from ..plans.chain import Pipeline
from ..sources.messages import parse_chart, parse_trades
from ..sources.replay import replay
from ..sources.tables import events_envelope, lineitem_envelope, table
from .common import EV, finish, r6


def trade_messages(spark, sf, faults=True):
    """lineitem rows as trade-tick JSON text; with ``faults``, rows with l_tax = 0 lack the
    ``q`` key."""
    li = table(spark, sf, "lineitem")
    msg = F.to_json(F.struct(
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("s"),
        F.col("l_extendedprice").cast("string").alias("p"),
        F.when((F.col("l_tax") != 0) | F.lit(not faults), F.col("l_quantity").cast("string")).alias("q"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("T"),
        (F.col("l_linenumber") % 2 == 0).alias("m"),
    ))
    return li.select(msg.alias("value"))


def chart_messages(spark, sf):
    """One quote-chart JSON document per order, bars = its line items ordered by
    (line number, ship date, price) - line numbers repeat inside an order here."""
    li = table(spark, sf, "lineitem")
    bars = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber",
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
        F.col("l_extendedprice").alias("open"),
        (F.col("l_extendedprice") * (F.lit(1.0) + F.col("l_tax"))).alias("high"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("low"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * (F.lit(1.0) + F.col("l_tax"))).alias("close"),
        F.col("l_quantity").cast("long").alias("volume"),
    ))).alias("b"))
    quote = F.struct(*[F.col("b")[f].alias(f) for f in ("open", "high", "low", "close", "volume")])
    doc = F.struct(F.struct(F.array(F.struct(
        F.struct(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("symbol")).alias("meta"),
        F.col("b")["t"].alias("timestamp"),
        F.struct(F.array(quote).alias("quote")).alias("indicators"),
    )).alias("result")).alias("chart"))
    return bars.select(F.to_json(doc).alias("value"))


def q_trade_parse(spark, sf):
    ev = parse_trades(trade_messages(spark, sf), source="trades")
    return finish(ev.select("source", "type", "timestamp", "payload.*"))


def q_chart_parse(spark, sf):
    ev = parse_chart(chart_messages(spark, sf), source="chart")
    return finish(ev.select("source", "type", "timestamp", "payload.*"))


def q_replay_wrap(spark, sf):
    od = table(spark, sf, "orders")
    ev = replay(od, "orders_replay", ["o_orderdate", "o_orderkey"], epoch=0)
    return ev.select("event_id", "source", "type", "original_index",
                     F.get_json_object("payload", "$.o_orderkey").cast("long").alias("o_orderkey"))


CHAIN_CONFIG = {
    "preprocessing": {
        "default": [
            {"name": "validate_schema", "config": {"strict": True}},
            {"name": "drop_malformed", "config": {"required_payload_fields": ["price"]}},
            {"name": "no_such_operator", "config": {}},
        ],
        "pipelines": [
            {"source": "events", "operators": [
                {"name": "normalize_price", "config": {"fields": ["price"], "method": "min_max"}}]},
            {"source": "lineitem", "operators": [{"name": "aggregate", "config": {"window": "24h"}}]},
        ],
    }
}


def q_route_union(spark, sf):
    cols = ["event_id", "source", "type", "timestamp", "meta"]
    ev = events_envelope(spark, sf)
    li = lineitem_envelope(spark, sf)
    mixed = ev.select(*cols, payload_json(ev).alias("payload")).unionByName(
        li.select(*cols, payload_json(li).alias("payload")))
    out = Pipeline(CHAIN_CONFIG).transform(mixed)
    return finish(out.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sum("price_normalized").alias("s")))


ORACLE = {
    "trade_parse": """SELECT 'trades' AS source, 'trade' AS type, l_shipdate AS "timestamp",
       l_returnflag || l_linestatus AS symbol, round(l_extendedprice, 6) AS price, round(l_quantity, 6) AS quantity,
       CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side
FROM lineitem WHERE l_tax <> 0""",
    "chart_parse": """SELECT 'chart' AS source, 'price' AS type, arg_max(l_shipdate, (l_linenumber, l_shipdate, l_extendedprice)) AS "timestamp",
       'O' || CAST(l_orderkey AS VARCHAR) AS symbol,
       round(arg_max(l_extendedprice, (l_linenumber, l_shipdate, l_extendedprice)), 6) AS open,
       round(arg_max(l_extendedprice * (1.0 + l_tax), (l_linenumber, l_shipdate, l_extendedprice)), 6) AS high,
       round(arg_max(l_extendedprice * (1.0 - l_discount), (l_linenumber, l_shipdate, l_extendedprice)), 6) AS low,
       round(arg_max(l_extendedprice * (1.0 - l_discount) * (1.0 + l_tax), (l_linenumber, l_shipdate, l_extendedprice)), 6) AS close,
       arg_max(CAST(l_quantity AS BIGINT), (l_linenumber, l_shipdate, l_extendedprice)) AS volume
FROM lineitem GROUP BY l_orderkey""",
    "replay_wrap": """SELECT 'replay-' || CAST(i AS VARCHAR) || '-0' AS event_id, 'orders_replay' AS source,
       'replay' AS type, i AS original_index, o_orderkey
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)""",
    "route_union": f"""WITH {EV},
mm AS (SELECT *, min(price) OVER w AS mn, max(price) OVER w AS mx FROM ev
       WINDOW w AS (PARTITION BY source ORDER BY "timestamp", event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
nz AS (SELECT source, type, CASE WHEN mx <> mn THEN (price - mn) / (mx - mn) END AS pn FROM mm)
SELECT source, type, count(*) AS n, {r6("sum(pn)")} AS s FROM nz
GROUP BY source, type
UNION ALL
SELECT 'lineitem' AS source, l_returnflag || '_aggregated' AS type, count(DISTINCT date_trunc('day', l_shipdate)) AS n,
       CAST(NULL AS DOUBLE) AS s
FROM lineitem GROUP BY l_returnflag""",
}

QUERIES = {
    "trade_parse": q_trade_parse,
    "chart_parse": q_chart_parse,
    "replay_wrap": q_replay_wrap,
    "route_union": q_route_union,
}
