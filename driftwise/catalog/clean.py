"""Catalog: validation, features and bars over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bars import aggregate, flatten_bars
from ..functions.payload import set_field
from ..operators.validate import (drop_malformed, extract_numeric, parse_json_events, reject_json_events,
                                  validate_schema)
from ..sources.tables import LINEITEM_ORDER, events_envelope, events_faulty, events_raw_json, lineitem_envelope
from .common import EV, LI, finish, r6


def q_validate_strict(spark, sf):
    ev = validate_schema(events_envelope(spark, sf), strict=True)
    return finish(ev.select("event_id", "source", "type", "timestamp", "payload.*"))


def q_drop_malformed(spark, sf):
    ev = drop_malformed(events_raw_json(spark, sf), ["k"])
    return finish(ev.select("event_id", "type", "timestamp", "payload"))


def q_features_numeric(spark, sf):
    ev = extract_numeric(events_raw_json(spark, sf), ["k", "missing"])
    return finish(ev.select("event_id", F.col("features.k").alias("k"), F.col("features.missing").alias("missing")))


def q_clean_events(spark, sf):
    """Events of a feed with cut-off texts and absent keys that pass strict validation."""
    ev = drop_malformed(parse_json_events(events_faulty(spark, sf)), ["k"])
    return finish(ev.select("event_id", "source", "type", "timestamp",
                            F.get_json_object("payload", "$.k").cast("long").alias("k")))


def q_clean_rejects(spark, sf):
    """The texts of that feed that give no event, with the reason."""
    return reject_json_events(events_faulty(spark, sf)).select("row", "reason")


def q_payload_rewrite(spark, sf):
    """Two passes that write the same payload key: the other values keep their types."""
    ev = events_raw_json(spark, sf)
    for step in (1, 2):
        ev = ev.withColumn("payload", set_field(ev, "stamp", F.lit(step) + F.col("event_id").cast("long") % 3))
    ev = extract_numeric(ev, ["k", "stamp"])
    return finish(ev.select("event_id", F.col("features.k").alias("k"), F.col("features.stamp").alias("stamp")))


def _bars(df, window, order=("timestamp", "event_id")):
    return finish(flatten_bars(aggregate(df, window=window, order=order)))


def q_ohlcv_1h(spark, sf):
    return _bars(events_envelope(spark, sf), "1h")


def q_ohlcv_1d(spark, sf):
    return _bars(events_envelope(spark, sf), "24h")


def q_ohlcv_lineitem_day(spark, sf):
    return _bars(lineitem_envelope(spark, sf), "24h", order=LINEITEM_ORDER)


def _bars_sql(src: str, cte: str, unit: str, label: str, order: str) -> str:
    desc = ", ".join(f"{c} DESC" for c in order.split(", "))
    return f"""WITH {cte}
SELECT first(event_id ORDER BY {desc}) AS event_id, source, type || '_aggregated' AS type,
       date_trunc('{unit}', "timestamp") + INTERVAL 1 {unit} AS "timestamp",
       date_trunc('{unit}', "timestamp") AS window_start,
       '{{"window":"{label}","method":"ohlcv","original_count":' || count(*) || '}}' AS meta,
       {r6(f'first(price ORDER BY {order})')} AS open, {r6('max(price)')} AS high,
       {r6('min(price)')} AS low, {r6(f'first(price ORDER BY {desc})')} AS close,
       {r6('CAST(sum(quantity) AS DOUBLE)')} AS volume, count(*) AS count
FROM {src}
GROUP BY source, type, date_trunc('{unit}', "timestamp")
HAVING count(price) > 0 AND count(quantity) > 0"""


LI_ORDER = '"timestamp", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity'

QUERIES = {
    "clean_events": q_clean_events,
    "clean_rejects": q_clean_rejects,
    "payload_rewrite": q_payload_rewrite,
    "validate_strict": q_validate_strict,
    "drop_malformed": q_drop_malformed,
    "features_numeric": q_features_numeric,
    "ohlcv_1h": q_ohlcv_1h,
    "ohlcv_1d": q_ohlcv_1d,
    "ohlcv_lineitem_day": q_ohlcv_lineitem_day,
}

ORACLE = {
    "clean_events": """SELECT CAST(event_id AS VARCHAR) AS event_id, 'feed' AS source,
       CASE WHEN event_id % 11 <> 0 THEN event_type END AS type, date_trunc('second', ts) AS "timestamp", CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_id % 13 <> 5 AND event_id % 7 NOT IN (1, 2, 3, 4) AND json_extract(props, '$.k') IS NOT NULL""",
    "clean_rejects": """SELECT event_id AS row, CASE WHEN event_id % 13 = 5 THEN 'bad_json' ELSE 'missing:' ||
       CASE event_id % 7 WHEN 1 THEN 'event_id' WHEN 2 THEN 'type' WHEN 3 THEN 'timestamp' ELSE 'payload' END END AS reason
FROM events WHERE event_id % 13 = 5 OR event_id % 7 IN (1, 2, 3, 4)""",
    "payload_rewrite": """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       CAST(2 + event_id % 3 AS DOUBLE) AS stamp FROM events""",
    "validate_strict": f"""WITH {EV}
SELECT event_id, source, type, "timestamp", {r6('price')} AS price, quantity, user_id FROM ev
WHERE event_id IS NOT NULL AND source IS NOT NULL AND type IS NOT NULL AND "timestamp" IS NOT NULL""",
    "drop_malformed": """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS type, ts AS "timestamp",
       props AS payload
FROM events WHERE json_extract(props, '$.k') IS NOT NULL""",
    "features_numeric": """SELECT CAST(event_id AS VARCHAR) AS event_id,
       round(CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
                  THEN CAST(json_extract(props, '$.k') AS DOUBLE)
                  WHEN json_type(props, '$.k') = 'BOOLEAN'
                  THEN CAST(CAST(json_extract(props, '$.k') AS BOOLEAN) AS DOUBLE) END, 6) AS k,
       CAST(NULL AS DOUBLE) AS missing
FROM events
WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')""",
    "ohlcv_1h": _bars_sql("ev", EV, "hour", "1h", '"timestamp", event_id'),
    "ohlcv_1d": _bars_sql("ev", EV, "day", "24h", '"timestamp", event_id'),
    "ohlcv_lineitem_day": _bars_sql("li", LI, "day", "24h", LI_ORDER),
}
