"""Row frames whose cost per row does not grow with an aggregate over the frame for each row."""

import random
from collections import Counter

import numpy as np
import pytest

from driftwise.detectors.cluster import cluster_windows
from driftwise.detectors.common import adaptive_threshold, rolling_quantile
from driftwise.detectors.hst import scale_by_key
from driftwise.plans.rolling import has_shuffle
from tests.conftest import events


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_are_quantiles_of_the_last_scores_without_a_percentile_a_row(spark):
    rng = random.Random(2)
    xs = [round(rng.expovariate(1), 1) for _ in range(300)] + [float("nan"), 0.5, None]
    df = events(spark, [(f"e{i:04d}", "s", "t", i // 3, (x, None, None)) for i, x in enumerate(xs)]).select("event_id", "source", "timestamp", "payload.price")
    out = adaptive_threshold(df, "price", q=0.9, window=40)
    assert "percentile" not in plan(out)
    got = {r.event_id: (r.threshold, r.alert) for r in out.collect()}
    assert len(got) == len(xs) and got["e0302"] == (None, None)
    for i in range(300):
        t = np.quantile(xs[max(0, i - 39):i + 1], 0.9) if i >= 10 else 0.5
        assert got[f"e{i:04d}"] == (pytest.approx(t, abs=1e-12), xs[i] > got[f"e{i:04d}"][0])
    assert got["e0300"][1] and not got["e0301"][1]
    assert rolling_quantile(np.array([]), 0.5, 3).tolist() == []


def test_dominant_clusters_take_one_list_a_frame(spark):
    rng = random.Random(3)
    points = [[0.0], [1.0], [2.0]]
    xs = [float(min(2, max(0, i // 70 % 3 + rng.choice((-1, 0, 0, 1))))) for i in range(400)]
    df = events(spark, [(f"e{i:04d}", "s", "t", i, (x, None, None)) for i, x in enumerate(xs)])
    w = 12
    out = cluster_windows(df, ["price"], points, w, 0.3)
    assert plan(out).count(f"RowFrame, -{w - 1}, currentrow") <= 2
    got = [(r.event_id, r.dominant, r.ratio, r.prev_cluster) for r in out.orderBy("event_id").collect()]
    want, current = [], int(xs[w - 1])
    ids = [int(x) for x in xs]
    for i in range(2 * w - 2, len(ids)):
        frame = ids[i - w + 1:i + 1]
        best, n = Counter(frame).most_common(1)[0]  # ties: first seen
        if n / w >= 0.3:
            if best != current:
                want.append((f"e{i:04d}", best, n / w, current))
            current = best
    assert got == want and len(want) > 5


def test_scaling_by_few_keys_does_not_shuffle_the_rows(spark):
    df = events(spark, [(f"e{i}", None if i % 2 else "s", "t", i, (float(i), None, None)) for i in range(20)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scale_by_key(df, ["price"])
        assert not has_shuffle(out)
        got = {r.event_id: r.price_scaled for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"e{i}": pytest.approx((i - i % 2) / 18) for i in range(20)}
