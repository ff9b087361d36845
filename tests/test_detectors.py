"""Detectors: planted shifts, sequential models vs the Spark plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.detectors.adwin import Adwin, adwin_flags
from driftwise.detectors.cluster import cluster_windows, nearest
from driftwise.detectors.common import adaptive_threshold
from driftwise.detectors.drift import drift_flags
from driftwise.detectors.hst import build_trees, hst_scores
from tests.conftest import events


def _series(spark, values, source="s"):
    return events(spark, [(f"e{i:05d}", source, "t", i, (float(v), 1.0, None)) for i, v in enumerate(values)])


def test_adwin_detects_planted_shift_and_not_constant():
    rnd = random.Random(1)
    a = Adwin()
    hits = [i for i in range(2000) if a.update((0.0 if i < 1000 else 1.0) + rnd.gauss(0, 0.1)) is not None]
    assert hits and 1000 <= hits[0] < 1100
    c = Adwin()
    assert all(c.update(5.0) is None for _ in range(2000))


def test_adwin_batch_equals_sequential(spark):
    rnd = random.Random(2)
    vals = [rnd.gauss(0 if i < 600 else 3, 1) for i in range(1500)]
    got = [r.event_id for r in adwin_flags(_series(spark, vals), ["price"], grace_period=100).orderBy("event_id").collect()]
    a, want = Adwin(), []
    for i, v in enumerate(vals):
        if i + 1 < 100:
            continue
        if a.update(v) is not None:
            want.append(f"e{i:05d}")
    assert got == want and got


def test_drift_adjacent_planted(spark):
    vals = [10.0] * 300 + [20.0] * 300
    rows = drift_flags(_series(spark, vals), "price", frame=50, grace_period=100).filter("drift").collect()
    assert len(rows) == 1 and 300 <= int(rows[0].event_id[1:]) < 330  # within 30 rows of the shift
    assert rows[0].change_pct > 0
    assert drift_flags(_series(spark, [7.0] * 400), "price").filter("drift").count() == 0


def test_adaptive_threshold(spark):
    vals = [float(i % 7) for i in range(40)] + [100.0]
    df = _series(spark, vals).withColumn("score", F.col("payload.price"))
    got = {r.event_id: (r.threshold, r.alert) for r in adaptive_threshold(df, "score", window=20).collect()}
    assert got["e00000"] == (0.5, False)
    xs = vals[-20:]
    assert got["e00040"][0] == pytest.approx(float(np.percentile(xs, 95)))
    assert got["e00040"][1] is True


def model_hst(xs, trees, height, window, limit):
    """Sequential Half-Space Trees: reference mass from the previous full window."""
    def path(x, dims, splits):
        node, out = 1, [1]
        for _ in range(height):
            node = 2 * node + (1 if x[dims[node]] >= splits[node] else 0)
            out.append(node)
        return out
    scores = {}
    for i, x in enumerate(xs):
        b = i // window
        if b == 0:
            continue
        ref = xs[(b - 1) * window:b * window]
        total = 0.0
        for dims, splits in trees:
            masses = {}
            for r in ref:
                for n in path(r, dims, splits):
                    masses[n] = masses.get(n, 0) + 1
            for d, n in enumerate(path(x, dims, splits)):
                m = masses.get(n, 0)
                if m <= limit or d == height:
                    total += m * 2 ** d
                    break
        scores[i] = 1 - total / (len(trees) * window * 2 ** height)
    return scores


def test_hst_matches_sequential_model(spark):
    rnd = random.Random(5)
    xs = [[rnd.random(), rnd.random()] for _ in range(130)]
    xs[100] = [5.0, 5.0]
    rows = [(f"e{i:04d}", "s", "t", i, (x[0], x[1], None)) for i, x in enumerate(xs)]
    df = events(spark, rows).withColumn("a", F.col("payload.price")).withColumn("b", F.col("payload.quantity"))
    got = {int(r.event_id[1:]): r.score for r in
           hst_scores(df, ["a", "b"], n_trees=3, height=4, window_size=25, seed=11).collect()}
    want = model_hst(xs, build_trees(2, 3, 4, 11), 4, 25, 2.5)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def model_cluster(preds_all, window, threshold):
    """The reference's sequential rule (predictions start at sample ``window``)."""
    recent, current, out = [], None, {}
    for i, c in enumerate(preds_all):
        if i + 1 < window:
            continue
        recent.append(c)
        recent = recent[-2 * window:]
        if current is None:
            current = c
            continue
        if len(recent) >= window:
            w = recent[-window:]
            counts = {}
            for x in w:
                counts[x] = counts.get(x, 0) + 1
            dom = max(counts, key=counts.get)
            ratio = counts[dom] / window
            if dom != current and ratio >= threshold:
                out[i] = (current, dom, ratio)
                current = dom
    return out


def test_cluster_closed_form_equals_sequential(spark):
    rnd = random.Random(9)
    cents = [[0.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    vals, regime = [], 0
    for i in range(900):
        if i % 150 == 0:
            regime = rnd.randrange(3)
        c = cents[regime] if rnd.random() < 0.6 else cents[rnd.randrange(3)]
        vals.append((c[0] + rnd.gauss(0, 2), c[1] + rnd.gauss(0, 2)))
    rows = [(f"e{i:04d}", "s", "t", i, (x, y, None)) for i, (x, y) in enumerate(vals)]
    df = events(spark, rows)
    got = {int(r.event_id[1:]): (r.prev_cluster, r.dominant, r.ratio) for r in
           cluster_windows(df, ["price", "quantity"], cents, window_size=20, threshold=0.3).collect()}
    preds = [min(range(3), key=lambda k: ((x - cents[k][0]) ** 2 + (y - cents[k][1]) ** 2, k)) for x, y in vals]
    want = model_cluster(preds, 20, 0.3)
    assert got.keys() == want.keys() and len(want) > 3
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == want[k][1] and got[k][2] == pytest.approx(want[k][2])
