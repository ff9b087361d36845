"""Durations, window ids and timestamp text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(r"^\s*(\d+)\s*([A-Za-z]?)\s*$")
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600}
# An unknown unit means one minute, as in the reference's window parser.
_DEFAULT_SECONDS = 60


def parse_duration(text: str) -> int:
    """``"<n>s" | "<n>m" | "<n>h"`` -> seconds; any other unit -> 60."""
    m = _DURATION.match(str(text))
    if not m:
        raise ValueError(f"bad duration {text!r}")
    n, unit = int(m.group(1)), m.group(2).lower()
    if unit in _UNIT_SECONDS:
        return n * _UNIT_SECONDS[unit]
    return _DEFAULT_SECONDS


def iso_text(ts: Column) -> Column:
    """Timestamp -> ISO-8601 text with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def display_text(ts: Column) -> Column:
    """Timestamp -> ``yyyy-MM-dd HH:mm:ss`` (explanations)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_iso(text: Column) -> Column:
    """ISO text -> TIMESTAMP; unparseable -> null."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    )


_PY_TO_SPARK = [("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%f", "SSSSSS")]


def strftime_to_spark(fmt: str) -> str:
    """Translate the strptime codes used in source options to Spark's pattern."""
    out = fmt
    for py, sp in _PY_TO_SPARK:
        out = out.replace(py, sp)
    return out
