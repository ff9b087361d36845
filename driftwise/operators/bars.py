"""Time bars (OHLCV) per key and tumbling / sliding event-time window.

One ``groupBy(key, window)``: Spark runs it as partial aggregation before the
shuffle and final aggregation after, so a hot key costs one small row per map
task and window, never a large group. The same function serves streams when a
``watermark`` is given (append mode emits each window once it closes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import numeric_field, parsed, payload_kind
from ..functions.timefmt import parse_duration

KEY = ("source", "type")
ORDER = ("timestamp", "event_id")
METHODS = ("ohlcv",)


def _order_struct(order: Sequence[str]):
    return F.struct(*[F.col(c) for c in order])


def aggregate(
    df: DataFrame,
    window: str = "1m",
    method: str = "ohlcv",
    key: Sequence[str] = KEY,
    order: Sequence[str] = ORDER,
    slide: str | None = None,
    watermark: str | None = None,
    price: str = "price",
    quantity: str = "quantity",
) -> DataFrame:
    """OHLCV bars: open = first price, high, low, close = last price (in
    ``order``), volume = sum of quantity, count = rows in the window.

    Only rows carrying a numeric price count in the prices, only rows carrying a
    quantity in the volume; a window lacking either yields no bar. The bar is an
    envelope: type ``<type>_aggregated``, timestamp = window end, event_id = the
    window's last event, meta ``{window, method, original_count}``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown aggregate method {method!r}")
    seconds = parse_duration(window)
    win = f"{seconds} seconds"
    src = df
    if watermark:
        src = src.withWatermark("timestamp", watermark)
    src, held = parsed(src)
    p = numeric_field(src, price, held)
    q = numeric_field(src, quantity, held)
    ordered = _order_struct(order)
    with_p = F.when(p.isNotNull(), ordered)
    wcol = F.window("timestamp", win, f"{parse_duration(slide)} seconds") if slide else F.window("timestamp", win)
    grouped = src.select(*[F.col(k) for k in key], wcol.alias("_w"), p.alias("_p"), q.alias("_q"),
                         ordered.alias("_o"), with_p.alias("_po"), F.col("event_id").alias("_id"))
    bars = grouped.groupBy(*key, "_w").agg(
        F.min_by("_p", "_po").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_po").alias("close"),
        F.sum("_q").alias("volume"),
        F.count(F.lit(1)).alias("count"),
        F.count("_p").alias("_np"),
        F.count("_q").alias("_nq"),
        F.max_by("_id", "_o").alias("event_id"),
    )
    bars = bars.filter((F.col("_np") > 0) & (F.col("_nq") > 0))
    meta = F.to_json(
        F.struct(F.lit(window).alias("window"), F.lit(method).alias("method"), F.col("count").alias("original_count"))
    )
    cols = []
    for k in key:
        if k == "type":
            cols.append(F.concat(F.col("type"), F.lit("_aggregated")).alias("type"))
        else:
            cols.append(F.col(k))
    payload = F.struct("open", "high", "low", "close", "volume", "count")
    if payload_kind(df) == "json":  # keep the payload's physical form
        payload = F.to_json(payload)
    return bars.select(
        "event_id",
        *cols,
        F.col("_w.end").alias("timestamp"),
        F.col("_w.start").alias("window_start"),
        payload.alias("payload"),
        meta.alias("meta"),
    )


def flatten_bars(bars: DataFrame) -> DataFrame:
    """Bars with payload fields as top-level columns."""
    return bars.select(*[c for c in bars.columns if c not in ("payload",)], "payload.*")
