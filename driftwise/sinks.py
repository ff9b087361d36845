"""Table sinks: day-partitioned Parquet tables, the per-batch router for
streams, and JSON / CSV exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import PATTERN_SCHEMA, TABLES, conform, event_date
from .functions.payload import payload_json
from .plans.query import accept_feedback
from .plans.rolling import materialize


# Partition column that keeps a stream's batches apart.
BATCH = "batch_id"


def to_table_layout(df: DataFrame, name: str) -> DataFrame:
    """Conform a DataFrame to a table's schema (JSON text payloads, timestamps),
    set ``ingest_time`` / ``processing_time`` when absent, add ``event_date``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    schema, sort_keys, partitioned = TABLES[name]
    out = df
    if "payload" in out.columns and name in ("raw_events", "clean_events"):
        out = out.withColumn("payload", payload_json(out))
    if name == "raw_events" and "ingest_time" not in out.columns:
        out = out.withColumn("ingest_time", F.current_timestamp())
    if name == "clean_events" and "processing_time" not in out.columns:
        pt = F.expr("try_variant_get(try_parse_json(meta), '$.processing_time', 'timestamp')") if "meta" in out.columns else F.lit(None)
        out = out.withColumn("processing_time", F.coalesce(pt.cast("timestamp"), F.current_timestamp()))
    out = conform(out, schema)
    if partitioned:
        out = out.withColumn("event_date", event_date())
    return out.sortWithinPartitions(*sort_keys)


def write_table(df: DataFrame, name: str, base_path: str, mode: str = "append", batch_id: int | None = None,
                files_per_day: int | None = None) -> str:
    """Write to ``<base_path>/<name>`` (Parquet, partitioned by event_date, rows sorted
    by the table's sort keys inside each file for row-group skipping).

    With ``batch_id`` the rows go to partitions of that batch, and those are replaced:
    writing a batch a second time changes nothing. ``files_per_day`` deals the rows of a
    day to that many files first; by default a task writes a file for every day it has."""
    path = f"{base_path.rstrip('/')}/{name}"
    out = to_table_layout(df, name)
    _, sort_keys, partitioned = TABLES[name]
    parts = ["event_date"] if partitioned else []
    if files_per_day:
        deal = F.pmod(F.xxhash64(*sort_keys), F.lit(files_per_day))
        out = out.repartition(*parts, deal).sortWithinPartitions(*parts, *sort_keys)
    if batch_id is not None:
        out, parts, mode = out.withColumn(BATCH, F.lit(batch_id).cast("long")), [BATCH, *parts], "overwrite"
    w = out.write.mode(mode).option("partitionOverwriteMode", "dynamic" if batch_id is not None else "static")
    (w.partitionBy(*parts) if parts else w).parquet(path)
    return path


def read_table(spark, name: str, base_path: str) -> DataFrame:
    """The table's columns and its day; batches are an inner matter of the writer."""
    return spark.read.parquet(f"{base_path.rstrip('/')}/{name}").drop(BATCH)


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_states(spark, base_path: str, turn: int) -> dict[str, dict[str, DataFrame]]:
    """The detectors' states after the turn before this one (none before the first)."""
    top = f"{base_path.rstrip('/')}/detector_state/{(turn - 1) % 2}"
    if turn == 0 or not _exists(spark, top):
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda p: [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
    out = {}
    for det in names(path):
        inner = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{det}")
        out[det] = {series: spark.read.parquet(f"{top}/{det}/{series}") for series in names(inner)}
    return out


def submit_feedback(spark, base_path: str, feedback: DataFrame, id_cols=("pattern_id", "user_id", "timestamp")
                    ) -> tuple[DataFrame, DataFrame]:
    """Check submitted ratings against the stored patterns and append the accepted ones to
    ``pattern_feedback``. Returns (feedback_id, pattern_id) of all accepted rows and the rejected
    rows with their reason. A row without a time gets the time of submission. The id
    follows from ``id_cols``, so a row that is submitted again, in one call or a later one, is accepted
    but stored once."""
    now = F.current_timestamp()
    given = feedback.withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in feedback.columns else now)
    base = base_path.rstrip("/")
    known = _exists(spark, f"{base}/pattern_events")
    patterns = read_table(spark, "pattern_events", base) if known else spark.createDataFrame([], PATTERN_SCHEMA)
    accepted, rejected = accept_feedback(materialize(given), patterns, id_cols)
    accepted = materialize(accepted)
    new = accepted.dropDuplicates(["feedback_id"])
    if _exists(spark, f"{base}/pattern_feedback"):
        new = new.join(read_table(spark, "pattern_feedback", base).select("feedback_id"), "feedback_id", "left_anti")
    write_table(new, "pattern_feedback", base)
    return accepted.select("feedback_id", "pattern_id"), rejected


def expire(spark, base_path: str, name: str, days: int, now) -> list[str]:
    """Drop the day partitions of a table that lie ``days`` days or more before the day of
    ``now``; returns them. Whole folders go and no live file is touched, so a running stream
    and readers of live days are not disturbed, and a second run finds nothing."""
    first = spark.range(1).select(F.date_sub(F.to_date(F.lit(now)), days - 1).cast("string")).first()[0]
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{base_path.rstrip('/')}/{name}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for pattern in ("event_date=*", f"{BATCH}=*/event_date=*"):
        for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, pattern)) or []:
            day = found.getPath().getName().split("=", 1)[1]
            if day < first and day != "__HIVE_DEFAULT_PARTITION__" and fs.delete(found.getPath(), True):
                gone.append(f"{found.getPath().getParent().getName()}/{found.getPath().getName()}")
    return sorted(gone)


def detect_batch(rows: DataFrame, base_path: str, engine, batch_id: int, turn: int) -> None:
    """Run the detectors over the rows of a batch, on from the state of the turn before, and
    write the patterns under the batch's id and the new state. Two states are held by turns,
    so a retried batch reads what it read at first and replaces what it wrote."""
    spark = rows.sparkSession
    found, states = engine.step(rows, read_states(spark, base_path, turn))
    if found is None:
        return
    write_table(found, "pattern_events", base_path, batch_id=batch_id)
    for det, series in states.items():
        for name, df in series.items():
            df.write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/detector_state/{turn % 2}/{det}/{name}")


def batch_router(base_path: str, clean: Callable[[DataFrame], DataFrame] | None = None, engine=None,
                 detect_every: int = 1, files_per_day: int = 1):
    """``foreachBatch`` function: raw -> clean -> patterns per micro-batch.

    The batch and its cleaned form are computed once, and both tables are written under
    the batch's id, so a batch that is retried replaces itself. The detectors of ``engine``
    go on from their state: every ``detect_every`` batches they read the clean rows of these
    batches and nothing older, and patterns are those of one run over all events in order,
    however they were cut into batches."""

    def route(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        cleaned = clean(batch).persist() if clean else batch
        try:
            write_table(batch, "raw_events", base_path, batch_id=epoch_id, files_per_day=files_per_day)
            write_table(cleaned, "clean_events", base_path, batch_id=epoch_id, files_per_day=files_per_day)
            if engine is not None and epoch_id % detect_every == detect_every - 1:
                rows = cleaned
                if detect_every > 1:
                    table = batch.sparkSession.read.parquet(f"{base_path.rstrip('/')}/clean_events")
                    rows = table.filter(F.col(BATCH).between(epoch_id - detect_every + 1, epoch_id)).drop(BATCH, "event_date")
                detect_batch(rows, base_path, engine, epoch_id, epoch_id // detect_every)
        finally:
            cleaned.unpersist()
            batch.unpersist()

    return route


def start_sinks(stream_df: DataFrame, base_path: str, checkpoint: str, clean=None, engine=None,
                trigger: dict | None = None, detect_every: int = 1, files_per_day: int = 1):
    """Start the raw / clean / pattern stream (one query, foreachBatch router)."""
    w = stream_df.writeStream.foreachBatch(batch_router(base_path, clean, engine, detect_every, files_per_day)).option(
        "checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def publish(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish rows as JSON messages to a topic (needs the Kafka connector)."""
    out = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


def export(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Export a result as JSON lines or CSV (nested columns as JSON text for CSV)."""
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map")
                           else F.col(f.name) for f in df.schema.fields])
        flat.write.mode(mode).option("header", True).option("escape", "\"").csv(path)  # RFC 4180 quotes
    else:
        raise ValueError(f"unknown export format {fmt!r}")
    return path
