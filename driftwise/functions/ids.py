"""Identifiers: fresh uuids or reproducible content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column | str) -> Column:
    """md5 over ``|``-joined parts: the same input gives the same id on any engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def fresh_id() -> Column:
    """A new random uuid per row (non-deterministic, like the reference)."""
    return F.expr("uuid()")
