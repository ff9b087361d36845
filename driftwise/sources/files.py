"""CSV / JSON file sources -> event envelope, batch or streaming.

* CSV with header: every value stays text; ``timestamp_field`` is parsed with
  ``timestamp_format`` and rows where it does not parse are dropped; without the
  field the time of processing is used.
* CSV without header: columns ``field_0 .. field_n``, timestamp = now.
* JSON files: a top-level array gives one event per item, an object one event;
  ``timestamp_field`` text (format) or epoch seconds, else now.
* Streaming: the file source remembers processed files in its checkpoint
  (``availableNow`` = process what is there and stop, like ``watch=False``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import strftime_to_spark
from .envelope import to_envelope

DEFAULT_TS_FORMAT = "%Y-%m-%d %H:%M:%S"


def _csv_envelope(raw: DataFrame, source: str, header: bool, timestamp_field: str, timestamp_format: str,
                  event_type: str, cast_numeric: bool) -> DataFrame:
    if not header:
        raw = raw.select(*[F.col(c).alias(f"field_{i}") for i, c in enumerate(raw.columns)])
    cols = raw.columns
    if cast_numeric:
        payload = F.struct(*[F.col(c).try_cast("double").alias(c) if c != timestamp_field else F.col(c) for c in cols])
    else:
        payload = F.struct(*[F.col(c) for c in cols])
    ts: Column | None = None
    if header and timestamp_field in cols:
        ts = F.try_to_timestamp(F.col(timestamp_field), F.lit(strftime_to_spark(timestamp_format)))
        raw = raw.withColumn("_ts", ts).filter(F.col("_ts").isNotNull())
        ts = F.col("_ts")
    env = to_envelope(raw, source, event_type, timestamp=ts, payload=F.to_json(payload))
    return env


def read_csv_events(spark: SparkSession, path: str, source: str, *, sep: str = ",", header: bool = True,
                    timestamp_field: str = "timestamp", timestamp_format: str = DEFAULT_TS_FORMAT,
                    event_type: str = "file_data", cast_numeric: bool = False) -> DataFrame:
    raw = spark.read.csv(path, header=header, sep=sep, inferSchema=False)
    return _csv_envelope(raw, source, header, timestamp_field, timestamp_format, event_type, cast_numeric)


def _json_items(text: Column) -> Column:
    """Whole-file JSON text -> array of item texts (array -> items, object -> [itself])."""
    trimmed = F.ltrim(text)
    as_array = F.from_json(text, "array<string>")
    return F.when(trimmed.startswith("["), as_array).otherwise(F.array(text))


def _json_envelope(raw: DataFrame, source: str, timestamp_field: str, timestamp_format: str,
                   event_type: str) -> DataFrame:
    items = raw.select(F.explode(_json_items(F.col("value"))).alias("item"))
    v = F.expr("try_parse_json(item)")
    tsv = F.expr(f"variant_get(try_parse_json(item), '$.{timestamp_field}')")
    kind = F.expr(f"schema_of_variant(variant_get(try_parse_json(item), '$.{timestamp_field}'))")
    as_text = F.try_to_timestamp(F.expr(f"try_variant_get(try_parse_json(item), '$.{timestamp_field}', 'string')"),
                                 F.lit(strftime_to_spark(timestamp_format)))
    as_num = F.timestamp_seconds(F.expr(f"try_variant_get(try_parse_json(item), '$.{timestamp_field}', 'double')"))
    ts = (F.when(tsv.isNull(), F.current_timestamp())
          .when(kind == "STRING", as_text)
          .when(kind.isin("BIGINT", "INT", "DOUBLE", "FLOAT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL"), as_num)
          .otherwise(F.current_timestamp()))
    parsed = items.filter(v.isNotNull()).withColumn("_ts", ts).filter(F.col("_ts").isNotNull())
    return to_envelope(parsed, source, event_type, timestamp=F.col("_ts"), payload=F.col("item"))


def read_json_events(spark: SparkSession, path: str, source: str, *, timestamp_field: str = "timestamp",
                     timestamp_format: str = DEFAULT_TS_FORMAT, event_type: str = "file_data") -> DataFrame:
    """One row per file (whole text), then items; a file is one task (JSON arrays are not splittable)."""
    raw = spark.read.text(path, wholetext=True)
    return _json_envelope(raw, source, timestamp_field, timestamp_format, event_type)


def rejected_json_items(spark: SparkSession, path: str, *, timestamp_field: str = "timestamp",
                        timestamp_format: str = DEFAULT_TS_FORMAT) -> DataFrame:
    """What ``read_json_events`` leaves out: ``file, item`` (place in the file, null for a
    whole file), ``reason`` and ``raw``. Reasons: ``bad_json`` (the file's text), ``empty``
    (no items), ``bad_timestamp``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    files = files.withColumn("_items", _json_items(F.col("raw")))
    whole = F.when(F.expr("try_parse_json(raw)").isNull(), "bad_json").when(F.size("_items") == 0, "empty")
    bad = files.withColumn("reason", whole).filter(F.col("reason").isNotNull()).select(
        "file", F.lit(None).cast("int").alias("item"), "reason", "raw")
    items = files.filter(whole.isNull()).select("file", F.posexplode("_items").alias("item", "raw"))
    text = F.expr(f"try_variant_get(try_parse_json(raw), '$.{timestamp_field}', 'string')")
    kind = F.expr(f"schema_of_variant(variant_get(try_parse_json(raw), '$.{timestamp_field}'))")
    late = items.filter((kind == "STRING") & F.try_to_timestamp(text, F.lit(strftime_to_spark(timestamp_format))).isNull())
    return bad.unionByName(late.select("file", "item", F.lit("bad_timestamp").alias("reason"), "raw"))


def rejected_csv_rows(spark: SparkSession, path: str, *, sep: str = ",", timestamp_field: str = "timestamp",
                      timestamp_format: str = DEFAULT_TS_FORMAT) -> DataFrame:
    """What ``read_csv_events`` leaves out of files with a header: ``file, reason, raw`` (the
    row as JSON). The reason is ``no_timestamp`` or ``bad_timestamp``."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    if timestamp_field not in raw.columns:  # times of processing are taken then
        return raw.limit(0).select(F.lit("").alias("file"), F.lit("").alias("reason"), F.lit("").alias("raw"))
    ts = F.try_to_timestamp(F.col(timestamp_field), F.lit(strftime_to_spark(timestamp_format)))
    reason = F.when(F.col(timestamp_field).isNull(), "no_timestamp").otherwise("bad_timestamp")
    return raw.filter(ts.isNull()).select(F.input_file_name().alias("file"), reason.alias("reason"),
                                          F.to_json(F.struct(*[F.col(c) for c in raw.columns])).alias("raw"))


def stream_files(spark: SparkSession, path: str, fmt: str, source: str, *, schema=None,
                 files_per_trigger: int | None = None, header: bool = True, sep: str = ",",
                 timestamp_field: str = "timestamp", timestamp_format: str = DEFAULT_TS_FORMAT,
                 event_type: str = "file_data") -> DataFrame:
    """Streaming file source (each new file once; the checkpoint remembers seen files).

    A changed file is not read again (the file source tracks paths): start a
    new checkpoint to reprocess."""
    rs = spark.readStream
    if files_per_trigger:
        rs = rs.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        if schema is None:
            raise ValueError("streaming CSV needs a schema (all STRING columns)")
        raw = rs.schema(schema).option("header", header).option("sep", sep).csv(path)
        return _csv_envelope(raw, source, header, timestamp_field, timestamp_format, event_type, False)
    if fmt == "json":
        raw = rs.option("wholetext", True).text(path)
        return _json_envelope(raw, source, timestamp_field, timestamp_format, event_type)
    raise ValueError(f"unknown file format {fmt!r}")
