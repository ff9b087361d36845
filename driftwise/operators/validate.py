"""Schema validation, malformed-payload drop, processing timestamp, numeric features.

All are narrow (per-row) expressions: Catalyst fuses them into the scan's
whole-stage-codegen span and pushes the null tests into the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import fresh_id
from ..functions.payload import has_field, numeric_field, payload_kind, replace_key
from ..functions.timefmt import iso_text, parse_iso

REQUIRED = ["event_id", "source", "type", "timestamp", "payload"]
ENVELOPE_JSON_FIELDS = REQUIRED + ["meta"]


def _and(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def validate_schema(df: DataFrame, strict: bool = True) -> DataFrame:
    """Typed envelope rows: strict drops rows missing any required field;
    lenient fills event_id (uuid), timestamp (now), payload ({}) and meta ({}).
    A column absent from the schema counts as missing on every row."""
    cols = set(df.columns)
    if strict:
        if not set(REQUIRED) <= cols:
            return df.limit(0)
        return df.filter(_and([F.col(c).isNotNull() for c in REQUIRED]))
    out = df
    defaults = {
        "event_id": fresh_id(),
        "timestamp": F.current_timestamp(),
        "payload": F.lit("{}"),
        "meta": F.lit("{}"),
    }
    for name, default in defaults.items():
        if name not in cols:
            out = out.withColumn(name, default)
        elif name == "payload" and payload_kind(df, "payload") != "json":
            continue  # typed payloads have no textual empty object
        else:
            out = out.withColumn(name, F.coalesce(F.col(name), default))
    return out


def parse_json_events(df: DataFrame, col: str = "value", strict: bool = True) -> DataFrame:
    """Raw JSON event text -> envelope with the reference's presence semantics:
    a key that is absent fails validation, a key with a JSON null passes.
    Lenient mode fills event_id / timestamp / payload / meta; source and type
    stay missing (null)."""
    v = F.expr(f"try_parse_json(`{col}`)")
    item = {f: F.expr(f"variant_get(try_parse_json(`{col}`), '$.{f}')") for f in ENVELOPE_JSON_FIELDS}
    present = {f: item[f].isNotNull() for f in ENVELOPE_JSON_FIELDS}
    ts_text = F.expr(f"try_variant_get(try_parse_json(`{col}`), '$.timestamp', 'string')")
    out = df.select(
        v.alias("_v"),
        *[present[f].alias(f"_has_{f}") for f in ENVELOPE_JSON_FIELDS],
        F.expr(f"try_variant_get(try_parse_json(`{col}`), '$.event_id', 'string')").alias("event_id"),
        F.expr(f"try_variant_get(try_parse_json(`{col}`), '$.source', 'string')").alias("source"),
        F.expr(f"try_variant_get(try_parse_json(`{col}`), '$.type', 'string')").alias("type"),
        parse_iso(ts_text).alias("timestamp"),
        F.to_json(item["payload"]).alias("payload"),
        F.to_json(item["meta"]).alias("meta"),
    ).filter(F.col("_v").isNotNull())
    if strict:
        out = out.filter(_and([F.col(f"_has_{f}") for f in REQUIRED]))
    else:
        out = (
            out.withColumn("event_id", F.when(F.col("_has_event_id"), F.col("event_id")).otherwise(fresh_id()))
            .withColumn("timestamp", F.when(F.col("_has_timestamp"), F.col("timestamp")).otherwise(F.current_timestamp()))
            .withColumn("payload", F.when(F.col("_has_payload"), F.col("payload")).otherwise(F.lit("{}")))
            .withColumn("meta", F.when(F.col("_has_meta"), F.col("meta")).otherwise(F.lit("{}")))
        )
    return out.select("event_id", "source", "type", "timestamp", "payload", "meta")


def reject_json_events(df: DataFrame, col: str = "value") -> DataFrame:
    """Complement of ``parse_json_events(strict=True)``: the input rows that give no
    event, with ``reason`` = ``bad_json``, ``not_an_object`` or ``missing:<field>`` (first
    that is absent)."""
    v = f"try_parse_json(`{col}`)"
    reason = F.lit(None).cast("string")
    for f in reversed(REQUIRED):
        reason = F.when(F.expr(f"variant_get({v}, '$.{f}')").isNull(), F.lit(f"missing:{f}")).otherwise(reason)
    kind = F.expr(f"schema_of_variant({v})")
    reason = F.when(F.expr(v).isNull(), "bad_json").when(~kind.startswith("OBJECT"), "not_an_object").otherwise(reason)
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def drop_malformed(df: DataFrame, required_payload_fields: Sequence[str] = ()) -> DataFrame:
    """Keep events whose payload has every listed key (null values count as present)."""
    if not required_payload_fields:
        return df
    return df.filter(_and([has_field(df, f) for f in required_payload_fields]))


def add_timestamp(df: DataFrame, field: str = "processing_time") -> DataFrame:
    """Stamp processing time: a TIMESTAMP column ``field`` and the same instant,
    as ISO text, under ``meta.<field>``."""
    now = F.current_timestamp()
    entry = F.concat(F.lit(f'"{field}":"'), iso_text(now), F.lit('"'))
    meta = F.coalesce(F.col("meta"), F.lit("{}")) if "meta" in df.columns else F.lit("{}")
    trimmed = F.regexp_replace(meta, r"\s*\}\s*$", "")
    merged = F.when(F.regexp_like(meta, F.lit(r"^\s*\{\s*\}\s*$")), F.concat(F.lit("{"), entry, F.lit("}"))).otherwise(
        F.concat(trimmed, F.lit(","), entry, F.lit("}"))
    )
    has_key = F.expr(f"variant_get(try_parse_json(meta), '$.{field}') IS NOT NULL") if "meta" in df.columns else F.lit(False)
    return df.withColumn("meta", F.when(has_key, replace_key(meta, field, entry)).otherwise(merged)).withColumn(field, now)


def extract_numeric(df: DataFrame, fields: Sequence[str], out: str = "features", skip_empty: bool = True) -> DataFrame:
    """Numeric feature projection: a STRUCT ``out`` with one DOUBLE per field,
    null where the key is missing or its value is not numeric; rows with no
    numeric field are skipped."""
    vals = [numeric_field(df, f).alias(f) for f in fields]
    res = df.withColumn(out, F.struct(*vals))
    if skip_empty and fields:
        res = res.filter(reduce(lambda a, b: a | b, [F.col(f"{out}.`{f}`").isNotNull() for f in fields]))
    return res


def dead_letter(df: DataFrame, required_payload_fields: Sequence[str] = ()) -> DataFrame:
    """Complement of validate_schema(strict) + drop_malformed, with a reason.

    Rows that the clean path drops come out here with ``reason`` =
    ``missing:<field>`` (first failing check)."""
    checks: list[tuple[Column, str]] = []
    for c in REQUIRED:
        if c in df.columns:
            checks.append((F.col(c).isNull(), f"missing:{c}"))
        else:
            checks.append((F.lit(True), f"missing:{c}"))
    for f in required_payload_fields:
        checks.append((~has_field(df, f), f"missing_payload:{f}"))
    reason = None
    for cond, text in reversed(checks):
        reason = F.when(cond, F.lit(text)) if reason is None else F.when(cond, F.lit(text)).otherwise(reason)
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())
