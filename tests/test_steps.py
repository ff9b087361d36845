"""Detectors that go on from batch to batch: any cut gives the patterns of one run."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.detectors.cluster import cluster_changes, cluster_step
from driftwise.plans.engine import PatternEngine
from driftwise.sinks import batch_router, read_states, read_table
from tests.conftest import events
from tests.test_detectors import model_cluster

ENGINE = {"detectors": [
    {"name": "adj", "type": "adwin", "source": "s", "config": {"fields": ["price", "quantity"], "method": "adjacent", "frame": 15, "grace_period": 40}},
    {"name": "seq", "type": "adwin", "source": "s", "config": {"fields": ["price"], "grace_period": 20, "key": ["source", "type"]}},
    {"name": "given", "type": "cluster_detector", "source": "s", "config": {"features": ["price"], "centroids": [[0.0], [50.0]], "window_size": 12}},
    {"name": "learned", "type": "cluster_detector", "source": "s", "config": {"features": ["price", "close"], "n_clusters": 3, "window_size": 10}},
    {"name": "hst", "type": "half_space_trees", "source": "s", "config": {"fields": ["price", "quantity"], "window_size": 20, "key": ["type"]}},
    {"name": "other", "type": "half_space_trees", "source": "nobody", "config": {"fields": ["price"], "window_size": 20}}]}


def stream(spark, n=420, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        level = 50.0 if (i // 70) % 2 else 0.0
        price = None if rng.random() < 0.05 else level + rng.gauss(0, 2)
        rows.append((f"e{i:05d}", "s" if rng.random() < 0.95 else "x", rng.choice("ab"), 1000 + i // 3,
                     (price, rng.uniform(0, 9), None if rng.random() < 0.2 else rng.gauss(level, 1))))
    return events(spark, rows)


def patterns(df):
    return {tuple(r[c] for c in ("pattern_id", "type", "detector_type", "timestamp", "details", "contributors")) for r in df.collect()}


KINDS = {"adj": ("drift", "adwin"), "seq": ("drift", "adwin"), "given": ("cluster_change", "cluster_detector"),
         "learned": ("cluster_change", "cluster_detector"), "hst": ("anomaly", "half_space_trees")}


@pytest.mark.parametrize("name", KINDS)
def test_any_cut_equals_one_run(spark, name):
    """Cuts of one row, within a window and behind several windows."""
    df = stream(spark, 300)
    engine = PatternEngine({"detectors": [d for d in ENGINE["detectors"] if d["name"] in (name, "other")]})
    want = patterns(engine.detect(df))
    assert {(w[1], w[2]) for w in want} == {KINDS[name]}
    got, states = [], {}
    cuts = [0, 15, 170, 10**6] if name == "learned" else [0, 9, 10, 170, 10**6]  # the former has the longest plans
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        found, new = engine.step(df.filter(F.substring("event_id", 2, 5).cast("int").between(lo, hi - 1)), states)
        got += sorted(patterns(found))
        states = {d: {s: t.checkpoint() for s, t in series.items()} for d, series in new.items()}
    assert len(got) == len(set(got)) and set(got) == want


def sequential(values, k, window):
    """Predictions of learned clusters, row by row in plain Python."""
    first = np.array([v for v in values[:window]], float)
    first = np.where(np.isnan(first), np.nan_to_num(np.nanmean(first, axis=0)), first)
    anchors, near = [first[0]], ((first - first[0]) ** 2).sum(axis=1)
    while len(anchors) < k:
        anchors.append(first[int(near.argmax())])
        near = np.minimum(near, ((first - anchors[-1]) ** 2).sum(axis=1))
    learned, preds = [[[] for _ in anchors[0]] for _ in anchors], []
    nearest = lambda x, points: min(range(k), key=lambda c: (sum((a - p) ** 2 for a, p in zip(x, points[c], strict=True) if a == a), c))
    for b in range(0, len(values), window):
        points = [[np.mean(v) if v else a for v, a in zip(learned[c], anchors[c], strict=True)] for c in range(k)]
        block = values[b:b + window]
        preds += [nearest(x, points) if b else None for x in block]
        for x in block:
            cell = nearest(x, anchors)
            for i, v in enumerate(x):
                if v == v:
                    learned[cell][i].append(v)
    return preds


def test_learned_clusters_equal_a_sequential_model(spark):
    rng = random.Random(6)
    values = [(rng.choice([0, 20, 45]) + rng.gauss(i / 60, 2), float("nan") if rng.random() < 0.1 else rng.gauss(i % 2 * 30, 3)) for i in range(333)]
    rows = [(f"e{i:04d}", "s", "t", i, (a, 1.0, None if b != b else b)) for i, (a, b) in enumerate(values)]
    df = events(spark, rows)
    changes, state = cluster_changes(df, {}, ["price", "close"], 4, 20, 0.3, ["source"], ["timestamp", "event_id"])
    got = {int(r.event_id[1:]): (r.prev_cluster, r.dominant, r.ratio, r.cluster) for r in changes.collect()}
    preds = sequential(values, 4, 20)
    want = model_cluster([0] * 19 + preds[20:], 20, 0.3)
    assert got == {i + 1: (p, d, pytest.approx(r), preds[i + 1]) for i, (p, d, r) in want.items()} and len(want) > 3
    assert state["cells"].agg(F.sum("n0")).first()[0] == 320  # complete blocks


def test_a_key_without_a_full_window_has_no_clusters(spark):
    df = events(spark, [(f"e{i}", "s", "t", i, (float(i), 1.0, None)) for i in range(15)])
    found, state = cluster_step(df, None, ["price"], 3, 20)
    assert found.count() == 0 and state["anchors"].count() == 0
    found, state = cluster_step(df.limit(0), state, ["price"], 3, 20)
    assert found.count() == 0 and state["rows"].count() == 15


def test_batches_are_read_once_and_time_does_not_grow(spark, tmpdir_path):
    """A turn's work does not depend on how many came before it; a retry changes nothing."""
    config = {"detectors": [{"name": "d", "type": "adwin", "source": "s", "config": {"fields": ["price"], "method": "adjacent", "frame": 15, "grace_period": 40}}]}
    engine = PatternEngine(config)
    df = stream(spark, 180).withColumn("payload", F.to_json("payload")).persist()
    read, times = [], []
    plain = engine.step

    def step(rows, states):
        read.append(rows.count())
        return plain(rows, states)

    engine.step = step
    route = batch_router(tmpdir_path, engine=engine)
    at = F.substring("event_id", 2, 5).cast("int")
    for i in [0, 1, 1, *range(2, 9)]:
        t0 = time.time()
        route(df.filter(at.between(20 * i, 20 * i + 19)), i)
        times.append(time.time() - t0)
    assert read == [20] * 10
    assert sum(times[-3:]) < 2 * sum(times[3:6]) + 3
    got = {r.pattern_id for r in read_table(spark, "pattern_events", tmpdir_path).collect()}
    want = {r.pattern_id for r in PatternEngine(config).detect(df).collect()}
    assert got == want and want
    assert set(read_states(spark, tmpdir_path, 9)) == {"detector0"} and read_states(spark, tmpdir_path, 0) == {}
    assert sorted(os.listdir(f"{tmpdir_path}/detector_state")) == ["0", "1"]


def test_detection_every_few_batches(spark, tmpdir_path):
    config = {"detectors": [ENGINE["detectors"][2]]}
    df = stream(spark, 300).withColumn("payload", F.to_json("payload"))
    route = batch_router(tmpdir_path, engine=PatternEngine(config), detect_every=3)
    at = F.substring("event_id", 2, 5).cast("int")
    for i in range(6):
        route(df.filter(at.between(50 * i, 50 * i + 49)), i)
    got = {r.pattern_id for r in read_table(spark, "pattern_events", tmpdir_path).collect()}
    assert got == {r.pattern_id for r in PatternEngine(config).detect(df).collect()} and got
