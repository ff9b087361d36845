"""Cluster-regime change: predict a cluster per row, find the dominant cluster of
the last ``window_size`` predictions and report when it changes.

The reference's rule is sequential (``current`` changes only when a change is
reported), but it has a closed form: ``current`` before a row is the dominant
cluster of the last *eligible* row (full window, ratio >= threshold), or the
first prediction. So: windowed counts per cluster -> eligible rows -> ``lag``
over eligible rows (seeded with the first prediction) -> compare. All window
functions over the hot-key planner; no sequential state.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import numeric_field
from ..plans.rolling import Frame, materialize, null_safe_join, over_rows, running_rows
from .common import ORDER, equal_contributors, to_patterns
from .series import BASE, NEW, RN, State, continued, last_rows, numbered, slim, stepwise


def nearest(xs: Sequence[Column], centroids: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centroid (squared Euclidean over the fields the row has;
    ties -> lowest index)."""
    dists = []
    for k, c in enumerate(centroids):
        d = sum((F.coalesce((x - F.lit(float(cv))) ** 2, F.lit(0.0)) for x, cv in zip(xs, c)), F.lit(0.0))
        dists.append(F.struct(d.alias("d"), F.lit(k).alias("k")))
    return F.least(*dists)["k"]


def fit_centroids(df: DataFrame, fields: Sequence[str], n_clusters: int, seed: int = 0) -> list[list[float]]:
    """k-means (Spark ML) over all rows with at least one of the fields; a missing field
    counts as the field's mean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = df.select(*[numeric_field(df, f).alias(f"_x{i}") for i, f in enumerate(fields)]).na.drop("all")
    names = x.columns
    mean = x.agg(*[F.avg(n).alias(n) for n in names]).first()
    x = x.na.fill({n: mean[n] for n in names if mean[n] is not None})
    vec = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(x)
    model = KMeans(k=n_clusters, seed=seed).fit(vec)
    return [list(map(float, c)) for c in model.clusterCenters()]


def cluster_windows(
    df: DataFrame,
    fields: Sequence[str],
    centroids: Sequence[Sequence[float]],
    window_size: int = 50,
    threshold: float = 0.3,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    split: bool = True,
) -> DataFrame:
    """Per row: ``cluster`` prediction (from row ``window_size`` on), dominant
    cluster and its ratio over the last ``window_size`` predictions, and
    ``change`` with ``prev_cluster`` where the regime changes."""
    xs = [numeric_field(df, f) for f in fields]
    names = [f"_x{i}" for i in range(len(xs))]
    rows = df.select("*", *[x.alias(n) for x, n in zip(xs, names, strict=True)]).na.drop("all", subset=names)
    pred = nearest([F.col(n) for n in names], centroids)
    out = over_rows(rows, key, order, window_size - 1,
                    lambda fr: _dominant(fr, fr.rn, pred, len(centroids), window_size, window_size), split=split).drop(*_frame_columns(len(centroids)))
    cand = _eligible(out, window_size, threshold)
    marked = over_rows(cand, key, order, 1, lambda fr: [F.lag("_reg", 1).over(fr.w).alias("prev_cluster")], split=split)
    return _changes(marked, threshold).drop("_reg", "_r", *names)


def _dominant(fr: Frame, rn: Column, pred: Column, k: int, window_size: int, first: int):
    """Row number, prediction (from row ``first`` on), and the dominant cluster of the last
    ``window_size`` predictions with its ratio, once there are that many."""
    full = first + window_size - 1
    stage1 = [F.when(rn >= first, pred).alias("cluster"), rn.alias("_r")]
    so_far = fr.w.rowsBetween(Window.unboundedPreceding, 0)
    # counts of a frame are differences of running counts; one list gives what came first
    stage2 = [F.sum(F.when(F.col("cluster") == c, 1).otherwise(0)).over(so_far).alias(f"_sum{c}") for c in range(k)]
    stage2.append(F.collect_list("cluster").over(fr.rows(window_size)).alias("_frame"))
    stage3, cands = [], []
    for c in range(k):
        before = F.coalesce(F.lag(f"_sum{c}", window_size).over(fr.w), F.lit(0))
        stage3.append((F.col(f"_sum{c}") - before).alias(f"_cnt{c}"))
        at = F.array_position("_frame", F.lit(c))
        cands.append(F.when(F.col(f"_cnt{c}") > 0, F.struct(F.col(f"_cnt{c}").alias("n"), (-at).alias("f"), F.lit(c).alias("k"))))
    dom = F.greatest(*cands) if k > 1 else cands[0]
    stage4 = [F.when(F.col("_r") >= full, dom["k"]).alias("dominant"),
              F.when(F.col("_r") >= full, dom["n"] / F.lit(float(window_size))).alias("ratio")]
    return [stage1, stage2, stage3, stage4]


def _frame_columns(k: int) -> list[str]:
    """Columns that ``_dominant`` leaves beside its results."""
    return ["_frame", *[f"{n}{c}" for n in ("_sum", "_cnt") for c in range(k)]]


def _eligible(out: DataFrame, first: int, threshold: float) -> DataFrame:
    """Rows with a clear dominant cluster, plus each key's first prediction as the seed of
    ``current``; ``_reg`` is the regime such a row stands for."""
    seed = F.col("_r") == first
    return out.filter(seed | (F.col("ratio") >= threshold)).withColumn("_reg", F.when(seed, F.col("cluster")).otherwise(F.col("dominant")))


def _changes(marked: DataFrame, threshold: float) -> DataFrame:
    return marked.filter((F.col("ratio") >= threshold) & (F.col("dominant") != F.col("prev_cluster"))).withColumn("change", F.lit(True))


# -- clusters that learn ----------------------------------------------------------------

def first_anchors(rows: DataFrame, names: Sequence[str], n_clusters: int, window_size: int, key: Sequence[str]) -> DataFrame:
    """Per key ``anchors``: ``n_clusters`` points of its first ``window_size`` rows (``_r``),
    farthest-first from the first row; a missing value counts as the mean of the first rows.
    A key without a full first window has none."""
    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("_r")
        x = np.stack([table.column(n).to_numpy() for n in names], axis=1)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            x = np.where(np.isnan(x), np.nan_to_num(np.nanmean(x, axis=0)), x)
        chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < n_clusters:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out = table.slice(0, 1).select(list(key))
        return out.append_column("anchors", pa.array([x[chosen].tolist()], pa.list_(pa.list_(pa.float64()))))

    first = rows.filter(F.col("_r") <= window_size).select(*key, "_r", *names)
    whole = first.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == window_size).drop("_n")
    schema = T.StructType([*[rows.schema[c] for c in key], T.StructField("anchors", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return null_safe_join(first, whole, key).groupBy(*key).applyInArrow(pick, schema)


def nearest_of(points: Column, xs: Sequence[Column], k: int) -> Column:
    """Index of the nearest of ``k`` points (an array of arrays) over the fields the row has;
    ties -> lowest index."""
    dists = []
    for c in range(k):
        d = sum((F.coalesce((x - points[c][i]) ** 2, F.lit(0.0)) for i, x in enumerate(xs)), F.lit(0.0))
        dists.append(F.struct(d.alias("d"), F.lit(c).alias("k")))
    return (F.least(*dists) if k > 1 else dists[0])["k"]


def learned_predictions(rows: DataFrame, state: State, names: Sequence[str], n_clusters: int, window_size: int, key: Sequence[str],
                        order: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Adds ``_pred``: the nearest centroid as learned before the row's block.

    Rows of a key form blocks of ``window_size`` (``_r``). The first block gives the anchors; a
    row is learned by the cell of its nearest anchor, and a centroid is the mean of all
    values learned in its cell by earlier blocks (the anchor while there are none). A block's
    sums do not depend on other blocks, so they are added up over blocks as running sums,
    whatever the key's size, and cluster ids never change. Rows of the first block have no
    prediction. ``state`` holds anchors and the cells' sums of complete blocks."""
    xs = [F.col(n) for n in names]
    kept = state.get("anchors")
    fresh_keys = rows if kept is None else null_safe_join(rows, kept.select(*key), key, how="left_anti")
    anchors = first_anchors(fresh_keys, names, n_clusters, window_size, key)
    if kept is not None:
        anchors = kept.unionByName(anchors)
    anchors = materialize(anchors)
    block = F.floor((F.col("_r") - 1) / F.lit(window_size)).cast("long")
    placed = null_safe_join(rows, anchors, key, how="left").withColumn("_b", block)
    # blocks that were complete before this step are in the kept sums
    opened = rows.filter(F.col(NEW) == 0).groupBy(*key).agg(F.floor(F.max("_r") / F.lit(window_size)).cast("long").alias("_from"))
    cells = null_safe_join(placed.filter(F.col("anchors").isNotNull()), opened, key, how="left").filter(F.col("_b") >= F.coalesce("_from", F.lit(0)))
    cells = cells.withColumn("_cell", nearest_of(F.col("anchors"), xs, n_clusters))
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.count(n).alias(f"n{i}") for i, n in enumerate(names)]
    stats = [f"{a}{i}" for a in "sn" for i in range(len(names))]
    fresh = cells.groupBy(*key, "_cell", "_b").agg(*sums)  # with the kept rows of the open block
    if state.get("cells") is not None:
        fresh = fresh.unionByName(state["cells"].withColumn("_b", F.lit(-1).cast("long")))
    fresh = materialize(fresh)
    # every block needs the sums of all cells before it
    blocks = fresh.select(*key, "_b").distinct().filter("_b >= 0")
    cell_ids = F.explode(F.sequence(F.lit(0), F.lit(n_clusters - 1))).alias("_cell")
    grid = blocks.select(*key, "_b", cell_ids).unionByName(
        fresh.filter("_b < 0").select(*key, "_b", F.col("_cell").cast("int")))
    grid = null_safe_join(grid, fresh, [*key, "_cell", "_b"], how="left").na.fill(0, stats)
    so_far = running_rows(grid, [*key, "_cell"], ["_b"],
                          lambda w: [(F.coalesce(F.col(f"_p{c}"), F.lit(0)) + F.sum(c).over(w) - F.col(c)).alias(f"_u{c}") for c in stats],
                          [F.sum(c).alias(f"_t{c}") for c in stats], lambda w: [F.sum(f"_t{c}").over(w).alias(f"_p{c}") for c in stats])
    point = F.array(*[F.when(F.col(f"_un{i}") > 0, F.col(f"_us{i}") / F.col(f"_un{i}")) for i in range(len(names))])
    centroids = so_far.filter("_b >= 0").groupBy(*key, "_b").agg(
        F.map_from_entries(F.collect_list(F.struct("_cell", point.alias("p")))).alias("_c"))
    met = null_safe_join(placed, centroids, [*key, "_b"], how="left")
    points = F.transform(F.col("anchors"), lambda a, c: F.transform(a, lambda v, i: F.coalesce(F.col("_c")[c][i], v)))
    pred = F.when((F.col("_b") > 0) & F.col("anchors").isNotNull(), nearest_of(F.col("_points"), xs, n_clusters))
    out = met.withColumn("_points", points).withColumn("_pred", pred).select(*rows.columns, "_pred")
    # complete blocks are summed up for the next step
    last = rows.groupBy(*key).agg(F.floor(F.max("_r") / F.lit(window_size)).cast("long").alias("_open"))
    done = null_safe_join(fresh, last, key).filter("_b < _open").groupBy(*key, "_cell").agg(*[F.sum(c).alias(c) for c in stats])
    return out, {"anchors": anchors, "cells": done}


def cluster_step(df: DataFrame, state: State | None, fields: Sequence[str], n_clusters: int = 4, window_size: int = 50,
                 threshold: float = 0.3, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER,
                 centroids: Sequence[Sequence[float]] | None = None, detector: str = "cluster") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cluster changes over the rows of a step: patterns, and the state for the next one.
    Without ``centroids`` they are learned (``learned_predictions``), and predictions begin
    with a key's second block."""
    key, order, state = list(key), list(order), state or {}
    changes, out = cluster_changes(df, state, fields, n_clusters, window_size, threshold, key, order, centroids)
    return _cluster_patterns(changes, detector, fields), out


def cluster_changes(df: DataFrame, state: State, fields: Sequence[str], n_clusters: int, window_size: int, threshold: float,
                    key: Sequence[str], order: Sequence[str], centroids: Sequence[Sequence[float]] | None = None
                    ) -> tuple[DataFrame, dict[str, DataFrame]]:
    names = [f"_x{i}" for i in range(len(fields))]
    new = slim(df, key, order, {n: numeric_field(df, f) for n, f in zip(names, fields, strict=True)})
    rows = materialize(continued(new, state.get("rows"), key))
    out = {}
    if centroids is not None:
        k, first, pred = len(centroids), window_size, nearest([F.col(n) for n in names], centroids)
        keep = window_size - 1
    else:
        k, first, keep = n_clusters, window_size + 1, 2 * window_size - 1
        indexed = materialize(numbered(rows, key, order).withColumnRenamed(RN, "_r"))
        rows, out = learned_predictions(indexed, state, names, k, window_size, key, order)
        # kept rows keep the prediction they had
        pred = F.coalesce(F.col("kept_pred"), F.col("_pred")) if "kept_pred" in rows.columns else F.col("_pred")
        rows = materialize(rows.withColumn("kept_pred", pred).drop("_pred", "_r"))
        pred = F.col("kept_pred")
    wide = over_rows(rows, key, stepwise(order), window_size - 1, lambda fr: _dominant(fr, fr.rn + F.col(BASE), pred, k, window_size, first)).drop(
        *_frame_columns(k))
    found = _eligible(wide, first, threshold).filter(F.col(NEW) == 1).drop(BASE, NEW, *names)
    found = materialize(continued(found, state.get("regime"), key))
    marked = over_rows(found, key, stepwise(order), 1, lambda fr: [F.lag("_reg", 1).over(fr.w).alias("prev_cluster")])
    out["rows"] = last_rows(rows, key, order, keep)
    out["regime"] = last_rows(found, key, order, 1)
    return _changes(marked.filter(F.col(NEW) == 1), threshold), out


def _cluster_patterns(ch: DataFrame, detector: str, fields: Sequence[str]) -> DataFrame:
    details = F.struct(F.lit(detector).alias("detector"), F.col("prev_cluster").alias("prev_cluster"),
                       F.col("dominant").alias("new_cluster"), F.col("ratio").alias("confidence"))
    return to_patterns(ch, "cluster_change", detector, "cluster_detector", details, equal_contributors(fields))


def detect_cluster_change(
    df: DataFrame,
    fields: Sequence[str],
    n_clusters: int = 4,
    window_size: int = 50,
    threshold: float = 0.3,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    centroids: Sequence[Sequence[float]] | None = None,
    detector: str = "cluster",
    seed: int = 0,
    split: bool = True,
) -> DataFrame:
    """Cluster-change patterns (details: prev_cluster, new_cluster, confidence = dominant
    ratio). Without ``centroids`` they are learned block by block from earlier rows."""
    if centroids is None:
        return cluster_step(df, None, fields, n_clusters, window_size, threshold, key, order, None, detector)[0]
    ch = cluster_windows(df, fields, centroids, window_size, threshold, key, order, split)
    return _cluster_patterns(ch, detector, fields)
