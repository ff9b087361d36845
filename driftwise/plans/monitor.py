"""Monitoring numbers as aggregations over the tables (counters, histograms,
latency statistics, gauges, status rollup). All are ``groupBy`` with partial
aggregation, so a hot label costs one partial row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .rolling import null_safe_join

DEFAULT_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5)
# ---- fixed values: rating labels ----
RATING_LABELS = {-1: "negative", 0: "neutral"}  # any other rating -> "positive"
STATUS_ORDER = ["healthy", "unknown", "unhealthy"]
# ---- end of fixed values ----


def event_counters(df: DataFrame, labels: Sequence[str] = ("source", "type")) -> DataFrame:
    """Count per label set (events, patterns, errors, requests ...)."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))


def latency_histogram(df: DataFrame, latency: str | Column, labels: Sequence[str] = (),
                      buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """Cumulative bucket counts ``le_<b>`` (latency <= b), ``count`` and ``sum``."""
    lat = F.col(latency) if isinstance(latency, str) else latency
    aggs = [F.sum(F.when(lat <= F.lit(float(b)), 1).otherwise(0)).alias(f"le_{b}") for b in buckets]
    aggs += [F.count(lat).alias("count"), F.sum(lat).alias("sum")]
    return df.groupBy(*labels).agg(*aggs)


def latency_stats(df: DataFrame, latency: str, labels: Sequence[str] = (), approx: bool = False,
                  accuracy: int = 10000, time_span: str | None = None) -> DataFrame:
    """count, min, max, mean, median, p95, p99 (linear interpolation, exact by
    default; ``approx=True`` uses ``percentile_approx`` for very large groups)
    and throughput = count / seconds spanned by ``time_span`` (if given)."""
    lat = F.col(latency)
    probs = [0.5, 0.95, 0.99]
    aggs = [F.count(lat).alias("count"), F.min(lat).alias("min"), F.max(lat).alias("max"), F.avg(lat).alias("mean")]
    if approx:
        aggs.append(F.percentile_approx(lat, probs, accuracy).alias("_q"))
    if time_span:
        span = F.unix_micros(F.max(time_span).cast("timestamp")) - F.unix_micros(F.min(time_span).cast("timestamp"))
        aggs.append(F.try_divide(F.count(lat), span / 1e6).alias("throughput"))
    out = df.groupBy(*labels).agg(*aggs)
    if not approx:  # bounded state, whatever the size of a group
        out = null_safe_join(out, exact_quantiles(df, labels, latency, probs), list(labels)) if labels else out.crossJoin(
            exact_quantiles(df, [], latency, probs))
    return out.select(*labels, *[c for c in out.columns if c not in labels and c != "_q"],
                      F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p95"), F.col("_q")[2].alias("p99"))


def latency_sketches(df: DataFrame, latency: str, labels: Sequence[str], ts: str, every: str = "hour", k: int = 400) -> DataFrame:
    """A row per label set and ``every`` (hour, day ...): ``slot``, count, min, max, sum and a
    mergeable quantile sketch of a few kB. Stored as a table, any range of it is answered by
    ``sketch_stats`` without the rows. With ``k`` = 400 a rank is off by about 0.7 % of n."""
    lat = F.col(latency).cast("double")
    return df.filter(lat.isNotNull()).groupBy(*labels, F.date_trunc(every, ts).alias("slot")).agg(
        F.count(F.lit(1)).alias("count"), F.min(lat).alias("min"), F.max(lat).alias("max"), F.sum(lat).alias("sum"),
        F.kll_sketch_agg_double(lat, F.lit(k)).alias("sketch"))


def sketch_stats(sketches: DataFrame, labels: Sequence[str], start=None, end=None) -> DataFrame:
    """``latency_stats`` of the slots in start <= slot < end, from stored sketches: count,
    min, max and mean exact, median, p95 and p99 within the sketch's error."""
    rows = sketches
    if start is not None:
        rows = rows.filter(F.col("slot") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("slot") < F.lit(end).cast("timestamp"))
    merged = rows.groupBy(*labels).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum("sum") / F.sum("count")).alias("mean"), F.kll_merge_agg_double("sketch").alias("_s"))
    at = lambda p: F.kll_sketch_get_quantile_double("_s", F.lit(p))
    return merged.select(*labels, "count", "min", "max", "mean", at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def rating_label(rating: Column) -> Column:
    out = F.lit("positive")
    for value, label in RATING_LABELS.items():
        out = F.when(rating == value, F.lit(label)).otherwise(out)
    return out


def feedback_labels(df: DataFrame, rating: str = "rating") -> DataFrame:
    return df.groupBy(rating_label(F.col(rating)).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def last_gauge(df: DataFrame, name: str = "queue", value: str = "size",
               order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Last value per gauge name (max_by over the order columns)."""
    return df.groupBy(name).agg(F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("value"))


def status_rollup(df: DataFrame, status: str = "status", by: Sequence[str] = ()) -> DataFrame:
    """Overall status: any unhealthy -> unhealthy, else any unknown -> unknown,
    else healthy (a max over a severity rank)."""
    sev = F.when(F.col(status) == "unhealthy", 2).when(F.col(status) == "healthy", 0).otherwise(1)
    out = df.groupBy(*by).agg(F.max(sev).alias("_s"), F.count(F.lit(1)).alias("components"))
    label = F.element_at(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("_s") + 1)
    return out.select(*by, label.alias("status"), "components")
