"""Stored quantile sketches: merged ranges against the rows."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from driftwise.plans.monitor import latency_sketches, sketch_stats


def test_merged_sketches_stay_within_their_error(spark, tmpdir_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), 3600 * rng.randint(0, 47) + rng.randint(0, 3599), rng.lognormvariate(0, 2)) for _ in range(20_000)] + [("a", 5, None)]
    df = spark.createDataFrame(rows, "src string, sec long, x double").withColumn("t", F.timestamp_seconds("sec"))
    latency_sketches(df, "x", ["src"], "t").write.parquet(f"{tmpdir_path}/sketches")
    stored = spark.read.parquet(f"{tmpdir_path}/sketches")
    assert stored.count() == 96
    for lo, hi in ((0, 48), (5, 29)):
        got = {r.src: r for r in sketch_stats(stored, ["src"], f"1970-01-0{1 + lo // 24} {lo % 24:02}:00:00", f"1970-01-0{1 + hi // 24} {hi % 24:02}:00:00").collect()}
        for src in "ab":
            xs = sorted(x for s, t, x in rows if s == src and x is not None and 3600 * lo <= t < 3600 * hi)
            r = got[src]
            assert (r["count"], r.min, r.max) == (len(xs), xs[0], xs[-1]) and r.mean == pytest.approx(sum(xs) / len(xs))
            for p, v in ((0.5, r.median), (0.95, r.p95), (0.99, r.p99)):
                assert bisect_left(xs, v) / len(xs) - 0.02 <= p <= bisect_right(xs, v) / len(xs) + 0.02
    assert sketch_stats(stored.limit(0), ["src"]).count() == 0
