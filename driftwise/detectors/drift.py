"""Concept drift per field.

``detect_drift_adjacent`` (scalable, SQL-checkable): for each row compare the
means of the two adjacent frames of ``frame`` rows ending at it, using the
ADWIN cut threshold (Bifet & Gavalda, SDM 2007) with variance bound

    m = 1 / (1/n0 + 1/n1),  d' = delta / (n0 + n1)
    eps = sqrt(2/m * var_W * ln(2/d')) + 2/(3m) * ln(2/d')

and fire on the first row of each run of rows where |mu_new - mu_old| > eps,
after the grace period. Pure window functions over the hot-key planner.

The exact sequential ADWIN lives in ``detectors.adwin``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import numeric_field
from ..plans.rolling import Frame, materialize, over_rows
from .common import ORDER, to_patterns
from .series import BASE, NEW, State, continued, last_rows, slim, stepwise

DRIFT_CONFIDENCE = 0.9


def adwin_epsilon(n0: int, n1: int, delta: float):
    """Pieces of the ADWIN cut for fixed frame sizes: (2/m * ln(2/d'), 2/(3m) * ln(2/d'))."""
    m = 1.0 / (1.0 / n0 + 1.0 / n1)
    ln = math.log(2.0 / (delta / (n0 + n1)))
    return 2.0 / m * ln, 2.0 / (3.0 * m) * ln


def drift_flags(
    df: DataFrame,
    field: str,
    frame: int = 50,
    delta: float = 0.002,
    grace_period: int = 100,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    split: bool = True,
) -> DataFrame:
    """Rows with a numeric ``field`` plus prev_mean / new_mean / change_pct and
    ``drift`` (first row of a run of cut rows)."""
    v = numeric_field(df, field)
    rows = df.withColumn("_v", v).filter(F.col("_v").isNotNull())
    out = over_rows(rows, key, order, 2 * frame, lambda fr: _flags(fr, frame, delta, grace_period), split=split)
    return out.drop("_cut", "_v")


def _flags(fr: Frame, frame: int, delta: float, grace_period: int, base: Column | None = None):
    """Both means, the change and the flag of each row; ``base`` is added to row numbers."""
    a, b = adwin_epsilon(frame, frame, delta)
    start = max(2 * frame, grace_period)
    old_w = fr.w.rowsBetween(-(2 * frame - 1), -frame)
    new_w = fr.rows(frame)
    all_w = fr.rows(2 * frame)
    old = F.avg("_v").over(old_w)
    new = F.avg("_v").over(new_w)
    var = F.var_pop("_v").over(all_w)
    eps = F.sqrt(F.lit(a) * var) + F.lit(b)
    rn = fr.rn if base is None else fr.rn + base
    cut = (rn >= start) & (F.abs(new - old) > eps)
    pct = F.when(old != 0, (new - old) / F.abs(old) * 100).otherwise(F.lit(0.0))
    stage1 = [old.alias("prev_mean"), new.alias("new_mean"), pct.alias("change_pct"),
              F.coalesce(cut, F.lit(False)).alias("_cut")]
    stage2 = [(F.col("_cut") & ~F.coalesce(F.lag("_cut", 1).over(fr.w), F.lit(False))).alias("drift")]
    return [stage1, stage2]


def drift_step(df: DataFrame, state: State | None, fields: Sequence[str], detector: str = "drift", frame: int = 50,
               delta: float = 0.002, grace_period: int = 100, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER
               ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``detect_drift_adjacent`` over the rows of a step: patterns, and per field the last
    two frames and one row for the next step."""
    state, out, hits = state or {}, {}, None
    for i, f in enumerate(fields):
        new = slim(df, key, order, {"_v": numeric_field(df, f)})
        rows = materialize(continued(new, state.get(f"field{i}"), key))
        flags = over_rows(rows, key, stepwise(order), 2 * frame, lambda fr: _flags(fr, frame, delta, grace_period, F.col(BASE)))
        hit = flags.filter(F.col("drift") & (F.col(NEW) == 1)).withColumn("field", F.lit(f))
        hits = hit if hits is None else hits.unionByName(hit)
        out[f"field{i}"] = last_rows(rows, key, order, 2 * frame + 1)
    return drift_patterns(hits, fields, detector), out


def detect_drift_adjacent(
    df: DataFrame,
    fields: Sequence[str],
    detector: str = "drift",
    frame: int = 50,
    delta: float = 0.002,
    grace_period: int = 100,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    split: bool = True,
) -> DataFrame:
    """Drift patterns: one per event where at least one field drifts; details hold
    ``<f>_prev_mean``, ``<f>_new_mean``, ``<f>_change_pct`` per drifting field and
    confidence 0.9; contributors share 1/n over the drifting fields."""
    parts = []
    for f in fields:
        fl = drift_flags(df, f, frame, delta, grace_period, key, order, split).filter("drift")
        parts.append(fl.select(
            "event_id", "source", "timestamp", *[c for c in key if c not in ("source",)],
            F.lit(f).alias("field"), "prev_mean", "new_mean", "change_pct"))
    if not parts:
        raise ValueError("no fields")
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return drift_patterns(allp, fields, detector)


def drift_patterns(hits: DataFrame, fields: Sequence[str], detector: str) -> DataFrame:
    """Pattern rows of (event, field) rows with both means and the change."""
    grouped = hits.groupBy("event_id", "source", "timestamp").agg(
        F.sort_array(F.collect_list(F.struct("field", "prev_mean", "new_mean", "change_pct"))).alias("fx"))
    detail_fields = []
    for f in fields:
        item = F.get(F.filter("fx", lambda x: x["field"] == F.lit(f)), F.lit(0))
        detail_fields += [item["prev_mean"].alias(f"{f}_prev_mean"), item["new_mean"].alias(f"{f}_new_mean"),
                          item["change_pct"].alias(f"{f}_change_pct")]
    details = F.struct(F.lit(detector).alias("detector"), *detail_fields,
                       F.lit(DRIFT_CONFIDENCE).alias("confidence"))
    n = F.size("fx")
    contributors = F.transform("fx", lambda x: F.struct(x["field"].alias("field"), (F.lit(1.0) / n).alias("score")))
    return to_patterns(grouped, "drift", detector, "adwin", details, contributors)
