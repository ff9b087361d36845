"""Cross-sectional operators per time point (documented tier 2).

A cross-section is the set of symbols at one time point, so a window
partitioned by the time column is bounded by the universe size (not by the
history length); per-time aggregates are ``groupBy`` with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rolling import null_safe_join


def cs_rank(df: DataFrame, col: str, ts: str = "ts", method: str = "dense") -> DataFrame:
    """``dense``: dense rank of ``col`` within its time point; ``minmax``:
    (x - min) / (max - min) within the time point (null when constant)."""
    w = Window.partitionBy(ts)
    if method == "dense":
        return df.withColumn(f"{col}_rank", F.dense_rank().over(w.orderBy(col)))
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(f"{col}_rank", F.when(hi > lo, (F.col(col) - lo) / (hi - lo)))


def cs_zscore(df: DataFrame, col: str, ts: str = "ts") -> DataFrame:
    """(x - mean) / sample std within the time point (null when std is 0 or undefined)."""
    st = df.groupBy(ts).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    j = null_safe_join(df, st, [ts])
    return j.withColumn(f"{col}_z", F.when(F.col("_s") > 0, (F.col(col) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def cs_winsorize(df: DataFrame, col: str, lower: float = 0.01, upper: float = 0.99, ts: str = "ts",
                 exact: bool = True) -> DataFrame:
    """``{col}_wins``: ``col`` clipped to its [lower, upper] quantiles (linear) within the time point;
    ``exact=False`` uses the mergeable approximate percentile sketch."""
    if exact:
        q = F.percentile(F.col(col), F.array(F.lit(lower), F.lit(upper)))
    else:
        q = F.percentile_approx(col, [lower, upper], 10000)
    st = df.groupBy(ts).agg(q.alias("_q"))
    j = null_safe_join(df, st, [ts])
    return j.withColumn(f"{col}_wins", F.least(F.greatest(F.col(col), F.col("_q")[0]), F.col("_q")[1])).drop("_q")


def neutralize(df: DataFrame, col: str, group: str, ts: str = "ts") -> DataFrame:
    """``{col}_neu``: ``col`` minus its mean within (time point, group)."""
    st = df.groupBy(ts, group).agg(F.avg(col).alias("_m"))
    return null_safe_join(df, st, [ts, group]).withColumn(f"{col}_neu", F.col(col) - F.col("_m")).drop("_m")


def topn_overlap(a: DataFrame, b: DataFrame, col_a: str, col_b: str, n: int, ts: str = "ts",
                 key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of the top-``n`` names by ``col_a`` that are also top-``n`` by ``col_b``, per time point."""
    def top(df, col):
        w = Window.partitionBy(ts).orderBy(F.col(col).desc(), *key)
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(ts, *key)

    ta = top(a, col_a)
    both = ta.join(top(b, col_b), [ts, *key])
    cnt_a = ta.groupBy(ts).agg(F.count(F.lit(1)).alias("_na"))
    cnt_b = both.groupBy(ts).agg(F.count(F.lit(1)).alias("_nb"))
    return cnt_a.join(cnt_b, ts, "left").select(ts, (F.coalesce("_nb", F.lit(0)) / F.col("_na")).alias("overlap"))
