"""The common event envelope (event_id, source, type, timestamp, payload, meta)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import fresh_id, stable_id

ADAPTER_VERSION = "1.0"
ENVELOPE = ["event_id", "source", "type", "timestamp", "payload", "meta"]


def _as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value)


def to_envelope(
    df: DataFrame,
    source: str | Column,
    type: str | Column,
    timestamp: Column | None = None,
    payload: Sequence[str] | Mapping[str, Column] | Column | None = None,
    id_cols: Sequence[str | Column] | None = None,
    meta: Mapping | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Wrap rows of any DataFrame into the envelope.

    * ``timestamp`` defaults to the time of processing (``current_timestamp``).
    * ``payload`` is a list of columns, a ``{name: Column}`` map (-> STRUCT) or a
      ready column (JSON text / VARIANT / STRUCT).
    * ``id_cols`` give a reproducible md5 id; without them each row gets a uuid.
    * ``meta`` always carries ``adapter_version``.
    * ``keep`` lists extra columns to carry along (e.g. tie-break keys).
    """
    if payload is None:
        payload_col = F.struct(*[F.col(c) for c in df.columns])
    elif isinstance(payload, Column):
        payload_col = payload
    elif isinstance(payload, Mapping):
        payload_col = F.struct(*[_as_col(v).alias(k) for k, v in payload.items()])
    else:
        payload_col = F.struct(*[F.col(c) for c in payload])
    meta_obj = dict(meta or {})
    meta_obj["adapter_version"] = ADAPTER_VERSION
    event_id = stable_id(*id_cols) if id_cols else fresh_id()
    ts = timestamp if timestamp is not None else F.current_timestamp()
    return df.select(
        event_id.alias("event_id"),
        _as_col(source).cast("string").alias("source"),
        _as_col(type).cast("string").alias("type"),
        ts.cast("timestamp").alias("timestamp"),
        payload_col.alias("payload"),
        F.lit(json.dumps(meta_obj, separators=(",", ":"))).alias("meta"),
        *[F.col(k) for k in keep],
    )
