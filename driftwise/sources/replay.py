"""Replay a table as events, and the load-test generators."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rolling import rows_index

# ---- fixed values: generator categories ----
CATEGORIES = ["A", "B", "C"]
# ---- end of fixed values ----


def replay(df: DataFrame, source: str, order: Sequence[str], epoch: int | None = None, rate: float | None = None,
           loops: int = 1) -> DataFrame:
    """Rows (in ``order``) -> events: id ``replay-<i>-<epoch>``, type ``replay``,
    timestamp = now, payload = the row, meta {replay: true, original_index: i}.
    The global index comes from the hot-key-safe row index (no single-task sort).

    With ``rate`` (rows a second) the events carry the times a paced replay that starts at
    ``epoch`` would send them at, in timestamp and, as whole seconds, in the id. ``loops`` passes
    follow each other; there is a pause between rows but none between passes, and events have
    their pass (from 0) in the column ``pass``."""
    if loops < 1 or (rate is not None and rate <= 0):
        raise ValueError("loops and rate must be positive")
    epoch = int(time.time()) if epoch is None else int(epoch)
    cols = df.columns
    idx = rows_index(df, [], order, name="_i").withColumn("_i", F.col("_i") - 1)
    at, sent = F.current_timestamp(), F.lit(epoch).cast("long")
    if loops > 1:
        idx = idx.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    if rate is not None:
        gaps = F.col("_i") + (F.col("_pass").cast("long") * (df.count() - 1) if loops > 1 else F.lit(0))
        at = F.timestamp_micros(F.lit(epoch * 1_000_000).cast("long") + F.round(gaps * (1e6 / rate)).cast("long"))
        sent = F.unix_seconds(at)
    return idx.select(
        F.concat(F.lit("replay-"), F.col("_i").cast("string"), F.lit("-"), sent.cast("string")).alias("event_id"),
        F.lit(source).alias("source"),
        F.lit("replay").alias("type"),
        at.alias("timestamp"),
        F.to_json(F.struct(*[F.col(c) for c in cols])).alias("payload"),
        F.to_json(F.struct(F.lit(True).alias("replay"), F.col("_i").alias("original_index"))).alias("meta"),
        F.col("_i").alias("original_index"),
        *([F.col("_pass").alias("pass")] if loops > 1 else []),
    )


def replay_stream(spark: SparkSession, path: str, fmt: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Paced replay: a file stream reading ``files_per_trigger`` files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def synthetic_events(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Load-test events: payload {index, value ~ U(0,1), category A/B/C, flag}."""
    r = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(0, n)
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    payload = F.struct(
        F.col("id").alias("index"),
        F.rand(seed).alias("value"),
        F.element_at(cats, (F.floor(F.rand(seed + 1) * len(CATEGORIES)) + 1).cast("int")).alias("category"),
        (F.rand(seed + 2) < 0.5).alias("flag"),
    )
    return r.select(
        F.concat(F.lit("benchmark-"), F.col("id").cast("string")).alias("event_id"),
        F.lit("benchmark").alias("source"), F.lit("test").alias("type"),
        F.current_timestamp().alias("timestamp"), payload.alias("payload"),
        F.lit('{"benchmark":true}').alias("meta"))


def synthetic_wave(spark: SparkSession, n: int) -> DataFrame:
    """Deterministic wave: price = 100 + (i % 10) * 10, volume = 1000 + (i % 5) * 100."""
    r = spark.range(0, n)
    payload = F.struct(F.col("id").alias("index"), (F.lit(100) + (F.col("id") % 10) * 10).alias("price"),
                       (F.lit(1000) + (F.col("id") % 5) * 100).alias("volume"))
    return r.select(
        F.concat(F.lit("benchmark-"), F.col("id").cast("string")).alias("event_id"),
        F.lit("benchmark").alias("source"), F.lit("test").alias("type"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"), payload.alias("payload"),
        F.lit('{"benchmark":true}').alias("meta"))
