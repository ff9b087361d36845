"""Catalog: rolling normalisation and SMA / EMA / RSI features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bars import aggregate
from ..operators.features import ema_weights, extract_features
from ..operators.normalize import normalize
from ..sources.tables import events_envelope
from .common import EV, finish, r6


def _norm(spark, sf, method):
    ev = normalize(events_envelope(spark, sf), ["price"], method=method, window_size=100)
    return finish(ev.select("event_id", F.col("payload.price").alias("price"), "price_normalized"))


def q_normalize_minmax(spark, sf):
    return _norm(spark, sf, "min_max")


def q_normalize_zscore(spark, sf):
    return _norm(spark, sf, "z_score")


def hourly_bars(spark, sf):
    return aggregate(events_envelope(spark, sf), window="1h")


def _feat(spark, sf, names):
    out = extract_features(hourly_bars(spark, sf), names, window_size=20)
    return finish(out.select("event_id", "type", "timestamp", F.col("payload.close").alias("close"), *names))


def q_sma(spark, sf):
    return _feat(spark, sf, ["sma_5", "sma_20"])


def q_ema(spark, sf):
    return _feat(spark, sf, ["ema_5", "ema_20"])


def q_rsi_14(spark, sf):
    return _feat(spark, sf, ["rsi_14"])


_W = 'PARTITION BY source ORDER BY "timestamp", event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW'

BARS = EV + """,
bars AS (
  SELECT source, type || '_aggregated' AS type,
         date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS "timestamp",
         first(event_id ORDER BY "timestamp" DESC, event_id DESC) AS event_id,
         first(price ORDER BY "timestamp" DESC, event_id DESC) AS close
  FROM ev GROUP BY source, type, date_trunc('hour', "timestamp")),
b AS (
  SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY "timestamp", event_id) AS rn,
         close - lag(close) OVER (PARTITION BY source, type ORDER BY "timestamp", event_id) AS d
  FROM bars)"""

_BW = 'PARTITION BY source, type ORDER BY "timestamp", event_id'


def _ema_sql(p: int) -> str:
    terms = []
    for j, wt in enumerate(ema_weights(p)):
        x = "close" if j == 0 else f"lag(close, {j}) OVER ({_BW})"
        terms.append(f"{wt!r} * {x}")
    return f"CASE WHEN rn >= {p} THEN {r6(' + '.join(terms))} END AS ema_{p}"


def _sma_sql(p: int) -> str:
    return f"CASE WHEN rn >= {p} THEN {r6(f'avg(close) OVER ({_BW} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)')} END AS sma_{p}"


_GAIN = f"sum(greatest(d, 0)) OVER ({_BW} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14"
_LOSS = f"sum(greatest(-d, 0)) OVER ({_BW} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14"

QUERIES = {
    "normalize_minmax": q_normalize_minmax,
    "normalize_zscore": q_normalize_zscore,
    "sma": q_sma,
    "ema": q_ema,
    "rsi_14": q_rsi_14,
}

ORACLE = {
    "normalize_minmax": f"""WITH {EV}
SELECT event_id, {r6('price')} AS price,
       {r6(f'CASE WHEN max(price) OVER ({_W}) <> min(price) OVER ({_W}) THEN (price - min(price) OVER ({_W})) / (max(price) OVER ({_W}) - min(price) OVER ({_W})) END')} AS price_normalized
FROM ev""",
    "normalize_zscore": f"""WITH {EV}
SELECT event_id, {r6('price')} AS price,
       {r6(f'CASE WHEN count(price) OVER ({_W}) > 1 THEN (price - avg(price) OVER ({_W})) / greatest(sqrt(var_pop(price) OVER ({_W})), 1e-8) END')} AS price_normalized
FROM ev""",
    "sma": f"""WITH {BARS}
SELECT event_id, type, "timestamp", {r6('close')} AS close, {_sma_sql(5)}, {_sma_sql(20)} FROM b""",
    "ema": f"""WITH {BARS}
SELECT event_id, type, "timestamp", {r6('close')} AS close, {_ema_sql(5)}, {_ema_sql(20)} FROM b""",
    "rsi_14": f"""WITH {BARS}
SELECT event_id, type, "timestamp", {r6('close')} AS close,
       CASE WHEN rn >= 15 THEN round(CASE WHEN {_LOSS} = 0 THEN 100.0
            ELSE 100.0 - 100.0 / (1.0 + ({_GAIN}) / ({_LOSS})) END, 6) END AS rsi_14
FROM b""",
}
