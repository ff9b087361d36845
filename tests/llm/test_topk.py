"""Exact top-k search against all inner products."""

import math
import random

from pyspark.sql import functions as F

from driftwise.llm import topk
from driftwise.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>"


def naive(rows, k, step):
    held = []
    for ident, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            limit = 1 << 24
            held.append((ident, [max(-limit, min(limit, math.floor(1024 * x))) for x in v]))
    out = []
    for i, (q, a) in enumerate(held):
        if q is not None and q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0) for j, (c, b) in enumerate(held) if i != j)
            out += [(q, rank, None if void else c, -s) for rank, (s, void, c) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def run(df, k=4, step=5, **kw):
    return sorted((tuple(r) for r in top_k(df, F.col("id") % step == 0, k=k, **kw).collect()), key=str)


def vectors(rng, n=300):
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(150)]  # one common vector
    rows += [(None, rows[7][1]), (None, [1.0] * 6), (5, rows[3][1]), (10, rows[10][1]), (10, rows[10][1])]
    rows += [(1000, None), (1005, [1.0, None]), (1010, [float("nan")]), (1015, [float("inf"), 1.0]), (1020, []), (1025, [0.0] * 6)]
    return rows + [(1030, [1e30, -1e30]), (1035, [0.5]), (-5, [1e-9] * 6), (1040, [-x for x in centres[0]])]


def test_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 16)
    monkeypatch.setattr(topk, "ANNULUS", 5)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rows = vectors(random.Random(1))
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == naive(rows, 4, 5)


def test_one_block_and_few_rows(spark):
    rows = vectors(random.Random(2), 40)
    assert run(spark.createDataFrame(rows, SCHEMA), k=10, pivots=3) == naive(rows, 10, 5)
    few = [(0, [1.0]), (5, [2.0]), (7, [3.0])]
    assert run(spark.createDataFrame(few, SCHEMA), k=10) == naive(few, 10, 5)
    assert run(spark.createDataFrame(few[:1], SCHEMA)) == []


def test_empty_and_clashing(spark):
    rows = vectors(random.Random(3), 30)
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df.limit(0)) == []
    clash = df.select("*", *[F.lit("x").alias(n) for n in ("id", "v", "block", "angle", "qid", "pivot", "rank", "score")])
    assert run(clash) == naive(rows, 4, 5)


def test_all_zero(spark):
    rows = [(i, [0.0, 0.0]) for i in range(30)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == naive(rows, 4, 5)


def test_bounds_prune(spark, monkeypatch):
    """Tight clusters: most blocks are not visited, and results stay exact."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 32)
    rng = random.Random(4)
    centres = [[10.0 if i == j else 0.0 for j in range(8)] for i in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 8]]) for i in range(800)]
    seen = []
    plain = topk.visit
    monkeypatch.setattr(topk, "visit", lambda index, sent, *a: (seen.append(sent.count()), plain(index, sent, *a))[1])
    assert run(spark.createDataFrame(rows, SCHEMA), step=10, k=3) == naive(rows, 3, 10)
    assert seen[1] < 80 * 24 / 2
