"""Pattern envelope, equal-share contributors and the adaptive alert threshold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import stable_id
from ..plans.rolling import materialize, place
from .series import NEW, continued, last_rows, stepwise

ORDER = ("timestamp", "event_id")
PATTERN_COLUMNS = ["pattern_id", "type", "detector_type", "timestamp", "source", "details", "contributors"]


def equal_contributors(fields: Sequence[str], present: Sequence[Column] | None = None) -> Column:
    """``[{field, score: 1/n}]`` over the fields present on the row."""
    if present is None:
        names = F.array(*[F.lit(f) for f in fields])
    else:
        names = F.filter(F.array(*[F.when(p, F.lit(f)) for f, p in zip(fields, present)]), lambda x: x.isNotNull())
    n = F.size(names)
    return F.transform(names, lambda f: F.struct(f.alias("field"), (F.lit(1.0) / n).alias("score")))


def to_patterns(
    df: DataFrame,
    pattern_type: str,
    detector: str,
    detector_type: str,
    details: Column,
    contributors: Column,
) -> DataFrame:
    """Rows that fired -> pattern envelope.

    ``type`` keeps the pattern kind (drift / anomaly / cluster_change) and
    ``detector_type`` the algorithm (adwin / half_space_trees / ...), where the
    reference overwrote one with the other. ``details`` always carries the
    detector name; ids are md5(source|detector|event_id), so reruns agree.
    """
    return df.select(
        stable_id("source", F.lit(detector), "event_id").alias("pattern_id"),
        F.lit(pattern_type).alias("type"),
        F.lit(detector_type).alias("detector_type"),
        F.col("timestamp"),
        F.col("source"),
        F.to_json(details.withField("detector", F.lit(detector))).alias("details"),
        F.to_json(contributors).alias("contributors"),
    )


def adaptive_threshold(
    df: DataFrame,
    score: str = "score",
    q: float = 0.95,
    window: int = 100,
    min_scores: int = 10,
    default: float = 0.5,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    split: bool = True,
) -> DataFrame:
    """``threshold`` = q-quantile (linear) of the last ``window`` scores incl. the
    current one once more than ``min_scores`` exist, else ``default``;
    ``alert`` = score > threshold. Rows without a score get neither."""
    scored = df.filter(F.col(score).isNotNull())
    rest = df.filter(F.col(score).isNull()).withColumn("threshold", F.lit(None).cast("double")).withColumn(
        "alert", F.lit(None).cast("boolean"))
    return _alerts(scored, score, q, window, min_scores, default, key, order, split).unionByName(rest)


def _alerts(scored: DataFrame, score: str, q: float, window: int, min_scores: int, default: float, key: Sequence[str],
            order: Sequence[str], split: bool = True) -> DataFrame:
    """``threshold`` and ``alert`` of rows that all have a score: row-frame blocks are Arrow
    groups, in which the frames of ``PIECE`` rows are sorted at once."""
    placed = place(scored, key, order, window - 1, most=GROUP_ROWS) if split else scored.select("*", F.lit(0).cast("long").alias("_blk"), F.lit(0).alias("_h"))
    w = Window.partitionBy(*key, "_blk").orderBy(*order)
    group = placed.select(*scored.columns, "_blk", (F.col("_h") == 0).alias("_own"), F.col(score).cast("double").alias("_x"), F.row_number().over(w).alias("_rn"))
    out = T.StructType([*scored.schema.fields, T.StructField("threshold", T.DoubleType()), T.StructField("alert", T.BooleanType())])

    names = scored.columns

    def alerts(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        x = table.column("_x").to_numpy()
        found = rolling_quantile(x, q, window)
        count = np.minimum(np.arange(1, len(x) + 1), window)
        found = np.where(count > min_scores, found, default)
        own = table.column("_own")
        table = table.select(names).append_column("threshold", pa.array(found)).append_column("alert", pa.array(_above(x, found)))
        return table.filter(own)

    return group.groupBy(*key, "_blk").applyInArrow(alerts, out)


GROUP_ROWS = 100_000  # rows of a key in one Arrow group
PIECE = 8_192  # rows whose frames are sorted at once


def _above(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``x > limit`` as in Spark, where NaN is above every number."""
    return np.where(np.isnan(x), ~np.isnan(limit), x > limit)


def rolling_quantile(x: np.ndarray, q: float, window: int) -> np.ndarray:
    """q-quantile (linear) of the last ``window`` values up to each, of fewer at the start; NaN
    counts as the largest value."""
    padded = np.concatenate([np.full(window - 1, np.nan), x])  # sorted behind all values
    out = np.empty(len(x))
    for at in range(0, len(x), PIECE):
        end = min(at + PIECE, len(x))
        frames = np.sort(np.lib.stride_tricks.sliding_window_view(padded[at:end + window - 1], window), axis=1)
        place_ = (np.minimum(np.arange(at + 1, end + 1), window) - 1) * q
        low, high = np.floor(place_).astype("i8"), np.ceil(place_).astype("i8")
        rows = np.arange(end - at)
        a, b = frames[rows, low], frames[rows, high]
        out[at:end] = np.where((low == high) | (a == b), a, (high - place_) * a + (place_ - low) * b)
    return out


def threshold_step(scored: DataFrame, kept: DataFrame | None, key: Sequence[str], order: Sequence[str], q: float = 0.95,
                   window: int = 100, min_scores: int = 10, default: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``adaptive_threshold`` over the rows of a step (column ``score``), and the scores that
    the next step needs."""
    rows = materialize(continued(scored, kept, key))
    out = _alerts(rows, "score", q, window, min_scores, default, key, stepwise(order))
    return out.filter(F.col(NEW) == 1), last_rows(rows, key, order, window - 1)


def anomaly_confidence(score: Column, threshold: Column) -> Column:
    return F.when(threshold < 1, (score - threshold) / (F.lit(1.0) - threshold)).otherwise(F.lit(0.5))
