"""Detector rows that go on from batch to batch.

A detector turns events into slim rows (key, order columns, event, values). What a later
batch needs of earlier ones is kept as tables: the last rows of every key with their row
numbers, and small sums per key. A step takes those tables and the new rows and returns
patterns and the tables for the next step; a run over all rows is one step from nothing,
so patterns are the same however rows in order are cut into batches.

Rows of a step come behind all kept rows, whatever their times: order is arrival by
batch, then the order columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rolling import null_safe_join, rows_index

# 1: row of this step, 0: kept row.  Rows of the key before the first row at hand.
NEW, BASE = "_new", "_base"
RN = "rn"  # row number within the key, over all steps

State = Mapping[str, DataFrame]


def continued(rows: DataFrame, kept: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """``rows`` behind the ``kept`` ones of an earlier step, with NEW and BASE. Kept rows may
    have columns that rows lack (null there)."""
    fresh = rows.withColumn(NEW, F.lit(1))
    if kept is None:
        return fresh.withColumn(BASE, F.lit(0).cast("long"))
    base = kept.groupBy(*key).agg((F.min(RN) - 1).alias(BASE))
    fresh = null_safe_join(fresh, base, key, how="left").withColumn(BASE, F.coalesce(BASE, F.lit(0)))
    old = null_safe_join(kept.drop(RN).withColumn(NEW, F.lit(0)), base, key)
    return old.unionByName(fresh, allowMissingColumns=True)


def stepwise(order: Sequence[str]) -> list[str]:
    """Order columns of a step's rows."""
    return [NEW, *order]


def last_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key with their RN, to be kept. Spark limits each task's
    share of a key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in stepwise(order)])
    back = rows.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n)
    total = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return null_safe_join(back, total, key).withColumn(RN, F.col(BASE) + F.col("_n") - F.col("_back") + 1).drop("_back", "_n", NEW, BASE)


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """RN of the rows of a step."""
    at = rows_index(rows, key, stepwise(order), name="_at")
    return at.withColumn(RN, F.col("_at") + F.col(BASE)).drop("_at")


def slim(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Mapping[str, object]) -> DataFrame:
    """Key, order and event columns with the named values; rows with at least one value."""
    carry = [c for c in dict.fromkeys([*key, *order, "event_id", "source", "timestamp"]) if c in df.columns]
    return df.select(*carry, *[v.alias(n) for n, v in values.items()]).na.drop("all", subset=list(values))
