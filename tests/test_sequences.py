"""Fusion of sources as of each event, and frequent ordered patterns, against plain Python."""

import random
from itertools import product

import pytest

from driftwise.extras.sequences import frequent_sequences, fuse_asof
from driftwise.plans import rolling


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(rolling, "TARGET_ROWS", 40)


def test_last_values_of_each_source(spark, small_blocks):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice("xyz"), rng.choice([None, *range(60)]), i,
             None if rng.random() < 0.3 else float(rng.randint(0, 99))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, src string, t int, id int, v double")
    got = fuse_asof({s: df.filter(df.src == s) for s in "xy"}, "v", ["k"], ["t", "id"])
    assert got.columns == ["k", "t", "id", "source_name", "x", "y"]
    want, last = [], {}
    for k, s, t, i, v in sorted((r for r in rows if r[1] in "xy"), key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        if v is not None:
            last[k, s] = v
        want.append((i, last.get((k, "x")), last.get((k, "y"))))
    assert sorted((r.id, r.x, r.y) for r in got.collect()) == sorted(want)


def test_frequent_ordered_patterns(spark, small_blocks):
    rng = random.Random(2)
    seqs = {u: [rng.choice("aabc") for _ in range(rng.randint(0, 6))] for u in range(40)}
    seqs[40], seqs[None] = ["a", "b"] * 150, ["c", "c", "a"]  # a long one and one without a key
    rows = [(u, i, x) for u, xs in seqs.items() for i, x in enumerate(xs)] + [(1, 99, None)]
    df = spark.createDataFrame(rows, "u int, o int, x string").repartition(3)

    def has(xs, pattern):
        it = iter(xs)
        return all(p in it for p in pattern)

    got = {tuple(r.pattern): (r.length, r.support) for r in frequent_sequences(df, "x", ["u"], ["o"], 12, 4).collect()}
    want = {}
    for n in range(1, 5):
        for p in product("abc", repeat=n):
            support = sum(has(xs, p) for xs in seqs.values())
            if support >= 12:
                want[p] = (n, support)
    assert got == want and max(map(len, want)) >= 2 and len(want) < 39
    assert frequent_sequences(df.limit(0), "x", ["u"], ["o"], 1).count() == 0
