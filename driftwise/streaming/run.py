"""Streaming entry points: watermarked bars and the raw -> clean -> patterns run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import aggregate
from ..sinks import start_sinks


def event_time(df: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ) event time."""
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def stream_bars(df: DataFrame, window: str = "1m", watermark: str = "0 seconds", slide: str | None = None,
                **kw) -> DataFrame:
    """OHLCV bars over a stream; a window is emitted once the watermark passes its end."""
    return aggregate(event_time(df), window=window, slide=slide, watermark=watermark, **kw)


def run_stages(stream_df: DataFrame, base_path: str, checkpoint: str, pipeline=None, engine=None,
               trigger: dict | None = None, detect_every: int = 1, files_per_day: int = 1):
    """One streaming query writing raw and clean (``pipeline.transform``) tables per
    micro-batch, and patterns (``engine.step``), every ``detect_every`` batches over what
    came since. A retried batch replaces itself."""
    clean = pipeline.transform if pipeline is not None else None
    return start_sinks(stream_df, base_path, checkpoint, clean=clean, engine=engine, trigger=trigger,
                       detect_every=detect_every, files_per_day=files_per_day)
