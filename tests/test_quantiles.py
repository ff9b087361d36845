"""Exact quantiles: NaN, infinities, the widest range, ties, many rounds."""

import math

import pytest
from pyspark.sql import functions as F

from driftwise.extras.quality import psi
from driftwise.functions import quantiles
from driftwise.functions.quantiles import exact_quantiles, rounds_for

PROBS = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
INF, NAN, BIG = math.inf, math.nan, 1.7976931348623157e308


def same(a, b):
    if a is None or b is None:
        return a is b
    return all((x != x and y != y) or x == pytest.approx(y, rel=1e-12) for x, y in zip(a, b, strict=True))


def frame(spark):
    one = 1.0
    values = {"nan": [1.0, NAN, 2.0, NAN, 3.0], "all_nan": [NAN, NAN], "inf": [INF, -INF, 0.0, 5.0], "infs": [INF] * 3 + [-INF] * 3,
              "wide": [BIG, -BIG, 0.0, 1e-308, -1e-308], "ulp": [one, math.nextafter(one, 2), math.nextafter(one, 0)] * 5,
              "ties": [4.0] * 900 + [5.0] * 99 + [6.0], "none": [None, None], "one": [2.5, None], "zero": [0.0, -0.0, 0.0],
              "many": [float((i * 7919) % 10007) for i in range(9000)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(None, 1.0), (None, 4.0)]
    return spark.createDataFrame(rows, "k string, x double").repartition(5)


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_equal_to_percentile(spark, monkeypatch, rows):
    """With brackets of 40 rows, several rounds are needed."""
    monkeypatch.setattr(quantiles, "ROUND_ROWS", rows)
    df = frame(spark)
    got = {r.k: r._q for r in exact_quantiles(df, ["k"], "x", PROBS).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert same(got[k], want[k]), (k, got[k], want[k])


def test_without_a_key_and_empty(spark):
    df = frame(spark)
    assert exact_quantiles(df.filter("k = 'many'"), [], "x", [0.5]).first()[0] == [float(df.filter("k = 'many'").agg(F.median("x")).first()[0])]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), [], "x", [0.5]).collect()] == [(None,)]
    assert exact_quantiles(df.limit(0), ["k"], "x", [0.5]).collect() == []


def test_rounds_are_few():
    assert rounds_for(10) == rounds_for(10**6) == 1 and rounds_for(10**9) == 3 and rounds_for(10**13) <= 6


def test_psi_leaves_rows_without_a_value_out(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    some = base.unionByName(spark.createDataFrame([(None,)] * 50, "x double"))
    assert psi(base, some, "x").first().psi == pytest.approx(0.0, abs=1e-9)
    assert psi(some, base, "x").first().psi == pytest.approx(0.0, abs=1e-9)
    assert psi(base, base.filter("x < 50"), "x").first().psi > 1
