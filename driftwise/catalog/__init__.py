"""Registered queries over the driver tables and their DuckDB oracle SQL.

Every query reads whole tables (no id subsets, no row caps) and returns a
DataFrame; ``ORACLE[name]`` is the same computation in ANSI SQL for DuckDB.
"""

from __future__ import annotations

from . import api, clean, detect, extras, frames, io

QUERIES: dict = {}
ORACLE: dict = {}

for _mod in (clean, frames, detect, api, io, extras):
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)


def flagship(spark, sf_dir: str):
    """events -> envelope -> strict validation + malformed drop -> hourly OHLCV
    bars -> SMA / EMA / RSI on close -> adaptive-threshold alerts on RSI ->
    pattern envelope -> explanation text."""
    from pyspark.sql import functions as F

    from ..detectors.common import adaptive_threshold, anomaly_confidence, to_patterns
    from ..detectors.explain import explain
    from ..operators.bars import aggregate
    from ..operators.features import extract_features
    from ..operators.validate import drop_malformed, validate_schema
    from ..sources.tables import events_envelope
    from .common import finish

    ev = drop_malformed(validate_schema(events_envelope(spark, sf_dir)), ["price", "quantity"])
    bars = aggregate(ev, window="1h")
    feats = extract_features(bars, ["sma_5", "ema_5", "rsi_14"], window_size=20)
    scored = feats.withColumn("score", F.col("rsi_14") / 100.0)
    alerts = adaptive_threshold(scored, "score", q=0.95, window=100, key=("source", "type")).filter("alert")
    details = F.struct(F.lit("rsi_alert").alias("detector"), F.col("score"), F.col("threshold"),
                       anomaly_confidence(F.col("score"), F.col("threshold")).alias("confidence"))
    contributors = F.array(F.struct(F.lit("rsi_14").alias("field"), F.lit(1.0).alias("score")))
    pats = to_patterns(alerts, "anomaly", "rsi_alert", "adaptive_threshold", details, contributors)
    return finish(explain(pats).select("pattern_id", "type", "timestamp", "source", "explanation"))
