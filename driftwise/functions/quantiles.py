"""Exact quantiles per key with bounded state.

``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable
quantile sketch (one pass, partial aggregation) gives a grid of values per key; the wanted
ranks lie between two grid values for certain, as the grid's steps are far wider than the
sketch's error. A round counts what lies below a bracket and sketches what lies inside,
which shrinks it sixteen times or more; how many rounds there are follows from the
largest key (``ROUND_ROWS``), so the work always ends. The last pass counts the values inside
the brackets, and the rank's value is read off the running count. The result is the linear
interpolation of ``percentile``, exactly; NaN counts as the largest value, as Spark orders
it, and infinities are values like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rolling import has_shuffle, materialize, null_safe_join

# Steps of the grid, the sketch's accuracy (a rank is off by 1 / accuracy at most), and the
# rows of a key that the last pass may meet inside a bracket.
GRID = 64
ACCURACY = 1000
ROUND_ROWS = 1_000_000


def rounds_for(rows: int) -> int:
    """Rounds that narrow a key of ``rows`` rows to ``ROUND_ROWS`` (a bracket spans
    four of 64 steps at most)."""
    return max(1, math.ceil(math.log(max(rows, 1) / ROUND_ROWS, GRID / 4))) if rows > ROUND_ROWS else 1


def _grid(value: Column) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))


def _bracket(rank: Column, rows: Column) -> list[Column]:
    """The grid values around a 0-based rank of ``rows`` values; null: no bound."""
    at = rank / rows * F.lit(float(GRID))
    return [F.get("_grid", (F.floor(at) - 1).cast("int")), F.get("_grid", (F.ceil(at) + 1).cast("int"))]


def exact_quantiles(df: DataFrame, key: Sequence[str], col: str, probs: Sequence[float], out: str = "_q") -> DataFrame:
    """``key`` and ``out``, the array of quantiles of the non-null ``col`` (null for a
    key without any value)."""
    if has_shuffle(df):
        df = materialize(df)
    keys = [f"_k{i}" for i in range(len(key))] or ["_k"]
    x = df.select(*([F.col(k).alias(n) for k, n in zip(key, keys, strict=True)] if key else [F.lit(0).alias("_k")]),
                  F.col(col).cast("double").alias("_x"))
    real = F.when(~F.isnan("_x"), F.col("_x"))
    base = materialize(x.groupBy(*keys).agg(F.count("_x").alias("_n"), F.count(real).alias("_m"), _grid(real).alias("_grid")))
    if not key and not base.first():  # an empty table is a group without values
        base = base.sparkSession.createDataFrame([(0, 0, 0, None)], base.schema)
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    open_ = base.filter("_n > 0").select(*keys, "_m", "_grid", F.explode(ranks).alias("_r")).filter("_r < _m")
    lo, hi = _bracket(F.col("_r"), F.col("_m"))
    brackets = open_.select(*keys, "_r", lo.alias("_lo"), hi.alias("_hi"))
    x = x.filter("_x IS NOT NULL AND NOT isnan(_x)")
    reached = (F.col("_hi").isNull() | (F.col("_x") <= F.col("_hi")))
    inside = F.when(F.col("_lo").isNull() | (F.col("_x") >= F.col("_lo")), F.col("_x"))
    largest = base.agg(F.max("_m")).first()[0] or 0
    for _ in range(rounds_for(largest) - 1):
        met = null_safe_join(x, brackets, keys).filter(reached).groupBy(*keys, "_r", "_lo", "_hi").agg(
            F.count_if(inside.isNull()).alias("_below"), F.count(inside).alias("_c"), _grid(inside).alias("_grid"))
        lo, hi = _bracket(F.col("_r") - F.col("_below"), F.col("_c"))
        brackets = materialize(met.select(*keys, "_r", F.coalesce(lo, "_lo").alias("_lo"), F.coalesce(hi, "_hi").alias("_hi")))
    counted = null_safe_join(x, brackets, keys).filter(reached).groupBy(*keys, "_r", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy("_v"))  # what lies below the bracket is null and comes first
    hit = counted.withColumn("_upto", upto).filter("_v IS NOT NULL AND _upto > _r AND _upto - _c <= _r")
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_v"))
    both = null_safe_join(base.select(*keys, "_n", "_m"), found, keys, how="left")

    def value(rank: Column) -> Column:
        return F.when(rank >= F.col("_m"), F.lit(float("nan"))).otherwise(F.col("_v")[rank])

    values = []
    for p in place:
        low, high = value(F.floor(p).cast("long")), value(F.ceil(p).cast("long"))
        share = p - F.floor(p)
        values.append(F.when((share == 0) | (low == high), low).otherwise((1 - share) * low + share * high))
    return both.select(*[F.col(n).alias(k) for n, k in zip(keys, key, strict=False)], F.when(F.col("_n") > 0, F.array(*values)).alias(out))
