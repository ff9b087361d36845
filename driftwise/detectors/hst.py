"""Half-Space Trees anomaly scores (Tan, Ting & Liu, IJCAI 2011).

Trees are fixed random half-space splits (seeded). Rows of a key are cut into
consecutive blocks of ``window_size`` rows; a row's *reference mass* at a node
is the number of rows of the previous block that pass through that node. Per tree
the terminal node is the first on the row's path with mass <= size limit (or the
leaf); score = 1 - sum(mass * 2^depth) / (n_trees * window_size * 2^height).

Rows are numbered and go to the row-frame planner's blocks (thousands of rows of a key, with
the rows before them as halo), and a block's windows are scored together in numpy from
Arrow columns: paths of all rows, and masses of 64 windows at a time. No sequential
state, a hot key is spread over its blocks, and the rows of the last two windows are all
that a later batch needs.

Rows of block 0 have no reference window and get no score. A row with at least one
of the features is scored; a missing one counts as the middle of the work space.
Inputs should be scaled to [0, 1]: by the range of all rows (``scale_by_key``), or by the
range of a key's first window, which a stream knows when it scores the second.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import numeric_field
from ..plans.rolling import materialize, null_safe_join, place
from .common import ORDER, adaptive_threshold, anomaly_confidence, equal_contributors, threshold_step, to_patterns
from .series import BASE, NEW, State, continued, last_rows, slim, stepwise

SIZE_LIMIT = 0.1
GROUP_ROWS = 100_000  # rows of a key that are scored in one Arrow group
FEW_KEYS = 10_000  # ranges of so many keys are sent to all tasks
STEP = 64  # windows scored at once


def build_trees(n_features: int, n_trees: int = 10, height: int = 8, seed: int = 0):
    """Per tree: (dims, splits) over heap node ids 1..2^height-1 (index 0 unused).

    Work space per dimension: s ~ U(0,1), r = 2 max(s, 1-s), range [s-r, s+r];
    each internal node splits a random dimension at the middle of its range."""
    rng = np.random.RandomState(seed)
    trees = []
    n_nodes = 2 ** height
    for _ in range(n_trees):
        s = rng.uniform(0.0, 1.0, n_features)
        r = 2.0 * np.maximum(s, 1.0 - s)
        lo0, hi0 = s - r, s + r
        dims = [0] * n_nodes
        splits = [0.0] * n_nodes
        stack = [(1, lo0.copy(), hi0.copy())]
        while stack:
            node, lo, hi = stack.pop()
            if node >= n_nodes:
                continue
            q = int(rng.randint(n_features))
            p = float((lo[q] + hi[q]) / 2.0)
            dims[node], splits[node] = q, p
            lhi = hi.copy()
            lhi[q] = p
            rlo = lo.copy()
            rlo[q] = p
            stack.append((2 * node + 1, rlo, hi.copy()))
            stack.append((2 * node, lo.copy(), lhi))
        trees.append((dims, splits))
    return trees


def scale_by_key(df: DataFrame, fields: Sequence[str], key: Sequence[str] = ("source",)) -> DataFrame:
    """Min-max scale each numeric field to [0, 1] with its per-key min and max
    (a small per-key aggregate joined back on the key)."""
    xs = {f: numeric_field(df, f) for f in fields}
    base = df.select("*", *[v.alias(f"_s_{f}") for f, v in xs.items()])
    stats = base.groupBy(*key).agg(*[F.min(f"_s_{f}").alias(f"_lo_{f}") for f in fields],
                                   *[F.max(f"_s_{f}").alias(f"_hi_{f}") for f in fields])
    # a few keys must not draw the rows into as few tasks
    stats = materialize(stats)
    j = null_safe_join(base, stats, list(key), broadcast=stats.count() <= FEW_KEYS)
    for f in fields:
        lo, hi = F.col(f"_lo_{f}"), F.col(f"_hi_{f}")
        j = j.withColumn(f"{f}_scaled", F.when(hi > lo, (F.col(f"_s_{f}") - lo) / (hi - lo)).otherwise(F.lit(0.0)))
    return j.drop(*[f"_s_{f}" for f in fields], *[f"_lo_{f}" for f in fields], *[f"_hi_{f}" for f in fields])


def hst_scores(
    df: DataFrame,
    features: Sequence[str],
    n_trees: int = 10,
    height: int = 8,
    window_size: int = 100,
    seed: int = 0,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    size_limit: float = SIZE_LIMIT,
    split: bool = True,
) -> DataFrame:
    """``score`` per row (columns ``features`` must be numeric columns of ``df``; rows
    with none of them are skipped). Returns key, order columns, event_id, score."""
    key, order = list(key), list(order)
    xs = {f"_x{i}": F.col(f).cast("double") for i, f in enumerate(features)}
    rows = slim(df, key, order, xs).withColumn(NEW, F.lit(1)).withColumn(BASE, F.lit(0).cast("long"))
    return _scored(rows, list(xs), n_trees, height, window_size, seed, key, order, size_limit, split)


def _scored(rows: DataFrame, xs: Sequence[str], n_trees: int, height: int, window_size: int, seed: int, key: Sequence[str],
            order: Sequence[str], size_limit: float, split: bool = True) -> DataFrame:
    """Scores of the new among ``rows`` (with NEW and BASE)."""
    by = list(dict.fromkeys([*key, "_blk"]))
    if split:
        placed = place(rows, key, stepwise(order), 2 * window_size - 1, most=GROUP_ROWS)
    else:
        placed = rows.select("*", F.lit(0).cast("long").alias("_blk"), F.lit(0).alias("_h"), F.lit(0).cast("long").alias("_off"))
    w = Window.partitionBy(*by).orderBy(*stepwise(order))
    own = (F.col("_h") == 0) & (F.col(NEW) == 1)
    carry = [c for c in rows.columns if c not in (*xs, NEW, BASE)]
    group = placed.select(*carry, *xs, "_blk", own.alias("_own"), (F.col(BASE) + F.col("_off") + F.row_number().over(w)).alias("_rn"))
    score = window_scorer(build_trees(len(xs), n_trees, height, seed), height, xs, carry, window_size,
                          size_limit * window_size, float(n_trees * window_size * (2 ** height)))
    out = T.StructType([*[rows.schema[c] for c in carry], T.StructField("score", T.DoubleType())])
    return group.groupBy(*by).applyInArrow(score, out)


def window_scorer(trees, height: int, xs: Sequence[str], carry: Sequence[str], window: int, limit: float, norm: float):
    """Arrow table of consecutive rows of a key (``_rn``) to the scores of those marked
    ``_own`` behind the first window."""
    dims = np.array([d for d, _ in trees])
    splits = np.array([s for _, s in trees])
    n_nodes = 2 ** (height + 1)
    each = np.arange(len(dims))[None, :]

    def some(x: np.ndarray, local: np.ndarray, windows: int) -> np.ndarray:
        """Scores of rows in windows 1.. of ``windows``; window 0 is reference only."""
        rows = np.arange(len(x))[:, None]
        node = np.ones((len(x), len(dims)), "i8")
        value = np.zeros(node.shape)
        open_ = np.ones(node.shape, bool)
        place = (local[:, None] * len(dims) + each) * n_nodes
        for depth in range(height + 1):
            mass = np.bincount((place + node).ravel(), minlength=windows * len(dims) * n_nodes)
            m = mass[np.maximum(place - len(dims) * n_nodes, 0) + node]
            stop = open_ & ((m <= limit) | (depth == height))
            value[stop] = m[stop] * 2.0 ** depth
            open_ &= ~stop
            if depth < height:
                node = 2 * node + (x[rows, dims[each, node]] >= splits[each, node])
        return 1.0 - value.sum(axis=1) / norm

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        at = (table.column("_rn").to_numpy() - 1) // window
        x = np.stack([table.column(c).to_numpy() for c in xs], axis=1)
        x = np.where(np.isnan(x), 0.5, x)
        result = np.zeros(len(x))
        for first in range(int(at[0]), int(at[-1]) + 1, STEP):
            held = slice(*np.searchsorted(at, [first - 1, first + STEP]))
            result_here = some(x[held], at[held] - (first - 1), STEP + 1)
            inner = at[held] >= first
            result[held] = np.where(inner, result_here, result[held])
        keep = table.column("_own").to_numpy(zero_copy_only=False) & (at > 0)
        mine = table.filter(pa.array(keep))
        return pa.table([*[mine.column(c) for c in carry], pa.array(result[keep])], names=[*carry, "score"])

    return score


def first_range(rows: DataFrame, kept: DataFrame | None, xs: Sequence[str], window: int, key: Sequence[str],
                order: Sequence[str]) -> DataFrame:
    """Per key the range of each value over its first ``window`` rows so far: ``_seen``, and
    ``_lo`` / ``_hi`` of every value. Spark limits a task's share of a key to ``window`` rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= window)
    if kept is not None:
        first = null_safe_join(first, kept.select(*key, "_seen"), key, how="left").filter(
            F.col("_at") + F.coalesce("_seen", F.lit(0)) <= window).drop("_seen")
    ranges = first.groupBy(*key).agg(F.count(F.lit(1)).alias("_seen"), *[f(x).alias(f"{n}{x}") for x in xs for n, f in (("_lo", F.min), ("_hi", F.max))])
    if kept is None:
        return ranges
    return kept.unionByName(ranges).groupBy(*key).agg(
        F.sum("_seen").alias("_seen"), *[f(f"{n}{x}").alias(f"{n}{x}") for x in xs for n, f in (("_lo", F.min), ("_hi", F.max))])


def anomaly_step(df: DataFrame, state: State | None, fields: Sequence[str], n_trees: int = 10, height: int = 8, window_size: int = 100,
                 threshold: float = 0.95, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER, seed: int = 0,
                 detector: str = "anomaly", scale: str = "first") -> tuple[DataFrame, dict[str, DataFrame]]:
    """``detect_anomaly`` over the rows of a step: patterns, and the state for the next one
    (rows of the last two windows, ranges of the first, the last scores).

    ``scale``: ``first`` scales by the range of a key's first window, ``none`` takes values
    as they are."""
    key, order, state = list(key), list(order), state or {}
    if scale not in ("first", "none"):
        raise ValueError(f"a step knows no scale {scale!r}")
    xs = [f"_x{i}" for i in range(len(fields))]
    new = slim(df, key, order, {x: numeric_field(df, f) for x, f in zip(xs, fields, strict=True)})
    rows = materialize(continued(new, state.get("rows"), key))
    ready, out = rows, {}
    if scale == "first":
        out["range"] = materialize(first_range(rows.filter(F.col(NEW) == 1), state.get("range"), xs, window_size, key, order))
        ready = null_safe_join(rows, out["range"].drop("_seen"), key, how="left")
        for x in xs:
            lo, hi = F.col(f"_lo{x}"), F.col(f"_hi{x}")
            ready = ready.withColumn(x, F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).when(F.col(x).isNotNull(), F.lit(0.0)))
        ready = ready.select(*rows.columns)
    scored = _scored(ready, xs, n_trees, height, window_size, seed, key, order, SIZE_LIMIT)
    alerts, out["scores"] = threshold_step(scored, state.get("scores"), key, order, q=threshold)
    out["rows"] = last_rows(rows, key, order, 2 * window_size - 1)
    return _anomalies(alerts.filter("alert"), detector, fields), out


def detect_anomaly(
    df: DataFrame,
    fields: Sequence[str],
    n_trees: int = 10,
    height: int = 8,
    window_size: int = 100,
    threshold: float = 0.95,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    seed: int = 0,
    detector: str = "anomaly",
    scale: bool = True,
    split: bool = True,
) -> DataFrame:
    """Anomaly patterns: HST score, adaptive q-threshold over the last 100
    scores, alert when score > threshold; details {score, threshold, confidence}."""
    if scale:
        src = scale_by_key(df, fields, key)
        feats = [f"{f}_scaled" for f in fields]
    else:
        src = df.select("*", *[numeric_field(df, f).alias(f"{f}_value") for f in fields])
        feats = [f"{f}_value" for f in fields]
    s = hst_scores(src, feats, n_trees, height, window_size, seed, key, order, split=split)
    return _anomalies(adaptive_threshold(s, "score", q=threshold, key=key, order=order, split=split).filter("alert"), detector, fields)


def _anomalies(th: DataFrame, detector: str, fields: Sequence[str]) -> DataFrame:
    details = F.struct(F.lit(detector).alias("detector"), F.col("score"), F.col("threshold"),
                       anomaly_confidence(F.col("score"), F.col("threshold")).alias("confidence"))
    return to_patterns(th, "anomaly", detector, "half_space_trees", details, equal_contributors(fields))
