"""Envelope and table schemas (raw, clean, pattern, feedback) and table creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fixed envelope every stage shares. ``payload`` and ``meta`` are JSON text
# at rest; in flight ``payload`` may also be a STRUCT (typed fast path) or VARIANT.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("payload", T.StringType()),
        T.StructField("meta", T.StringType()),
    ]
)

RAW_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField("ingest_time", T.TimestampType())])
CLEAN_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField("processing_time", T.TimestampType())])

CONTRIBUTOR = T.StructType([T.StructField("field", T.StringType()), T.StructField("score", T.DoubleType())])
CONTRIBUTORS = T.ArrayType(CONTRIBUTOR)

PATTERN_SCHEMA = T.StructType(
    [
        T.StructField("pattern_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("contributors", T.StringType()),
    ]
)

FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("feedback_id", T.StringType()),
        T.StructField("pattern_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("rating", T.ByteType()),
        T.StructField("comment", T.StringType()),
    ]
)

TABLES = {
    "raw_events": (RAW_SCHEMA, ["timestamp", "source", "type", "event_id"], True),
    "clean_events": (CLEAN_SCHEMA, ["timestamp", "source", "type", "event_id"], True),
    "pattern_events": (PATTERN_SCHEMA, ["timestamp", "source", "type", "pattern_id"], True),
    "pattern_feedback": (FEEDBACK_SCHEMA, ["pattern_id", "timestamp"], False),
}


def event_date(ts_col: str = "timestamp"):
    """Day partition column of a table (UTC day of the event time)."""
    return F.to_date(F.col(ts_col)).alias("event_date")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, casting; missing columns become null.

    STRUCT / MAP / ARRAY / VARIANT payloads are written as JSON text, so every
    table keeps the reference's JSON-at-rest layout.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        if field.name not in have:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        src = have[field.name]
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType) and isinstance(
            src, (T.StructType, T.MapType, T.ArrayType, T.VariantType)
        ):
            c = F.to_json(c)
        cols.append(c.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def create_tables(spark: SparkSession, base_path: str) -> dict[str, str]:
    """CREATE TABLE IF NOT EXISTS for the four tables as day-partitioned Parquet."""
    paths = {}
    for name, (schema, _, partitioned) in TABLES.items():
        path = f"{base_path.rstrip('/')}/{name}"
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        part = ""
        if partitioned:
            ddl += ", `event_date` date"
            part = " PARTITIONED BY (event_date)"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{part} LOCATION '{path}'")
        paths[name] = path
    return paths
