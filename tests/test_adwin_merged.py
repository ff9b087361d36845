"""ADWIN over mergeable buckets: chunks of any size against one plain pass."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from driftwise.detectors import adwin_merged
from driftwise.detectors.adwin import Adwin
from driftwise.detectors.adwin_merged import CELL, PER_LEVEL, Window, adwin_merged_flags
from driftwise.plans import rolling
from driftwise.plans.engine import PatternEngine
from tests.conftest import events


def plain(vals, delta=0.002):
    """One pass over whole cells: edges by the closed form, means and variance from the values."""
    out, start = [], 0
    for end in range(1, len(vals) // CELL + 1):
        first = start
        while True:
            seq = vals[start * CELL:end * CELL]
            mean = sum(seq) / len(seq)
            var = sum((x - mean) ** 2 for x in seq) / len(seq)
            ln = math.log(2 * math.log(len(seq)) / delta)
            edges = [e for e in range(start + 1, end)
                     if e - (e & -e) < start or end - e - (e & -e) < 2 * PER_LEVEL * (e & -e)]

            def differs(e):
                a, b = vals[start * CELL:e * CELL], vals[e * CELL:end * CELL]
                m = 1 / len(a) + 1 / len(b)
                return abs(sum(a) / len(a) - sum(b) / len(b)) > math.sqrt(2 * m * var * ln) + 2 / 3 * m * ln

            if not any(differs(e) for e in edges):
                break
            start = edges[0]
        if start > first:
            old, new = vals[first * CELL:start * CELL], vals[start * CELL:end * CELL]
            out.append((end * CELL - 1, sum(old) / len(old), sum(new) / len(new), len(new)))
    return out


def shifts(seed, n, every):
    rnd = random.Random(seed)
    return [rnd.gauss(4.0 * ((i // every) % 3), 1) for i in range(n)]


def frame(spark, parts):
    rows = [(f"{s}{i:06d}", s, "t", i // 3, (v, 1.0, None)) for s, vals in parts.items() for i, v in enumerate(vals)]
    return events(spark, rows)


def test_buckets_follow_from_start_and_end():
    rnd = random.Random(3)
    w = Window(5)
    for _ in range(700):
        w.add(rnd.random(), rnd.random())
        if rnd.random() < 0.01 and len(w.pos) > 3:
            w = w.since(w.pos[2])
        want = [w.start] + [e for e in range(w.start + 1, w.end)
                            if e - (e & -e) < w.start or w.end - e - (e & -e) < 2 * PER_LEVEL * (e & -e)]
        assert w.pos == want
    assert len(w.pos) <= 2 * (PER_LEVEL + 1) * 10


def test_merged_runs_equal_one_run():
    rnd = random.Random(4)
    cells = [(rnd.random(), rnd.random()) for _ in range(300)]
    one = Window(7)
    for c in cells:
        one.add(*c)
    for cut in (1, 50, 128, 299):
        a, b = Window(7), Window(7 + cut)
        for c in cells[:cut]:
            a.add(*c)
        for c in cells[cut:]:
            b.add(*c)
        both = a.behind(b)
        assert both.parts() == one.parts()  # bit for bit


@pytest.mark.parametrize("chunk", [1, 4, 16, 1024])
def test_one_hot_key_in_chunks_equals_one_pass(spark, chunk):
    vals = shifts(5, 6000, 1100)
    want = plain(vals)
    assert len(want) >= 5
    got = adwin_merged_flags(frame(spark, {"s": vals}), ["price"], grace_period=1, chunk=chunk).collect()
    got = sorted((int(r.event_id[1:]), r.prev_mean, r.new_mean, r.width) for r in got)
    assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:3] == pytest.approx(w[1:3], abs=1e-9)


def test_planted_shift_within_a_cell_of_the_exact_detector(spark):
    rnd = random.Random(6)
    vals = [rnd.gauss(0 if i < 2000 else 1.5, 1) for i in range(4000)]
    a = Adwin()
    exact = [i for i, v in enumerate(vals) if a.update(v) is not None]
    got = sorted(int(r.event_id[1:]) for r in adwin_merged_flags(frame(spark, {"s": vals}), ["price"], grace_period=1).collect())
    assert got and abs(got[0] - exact[0]) <= CELL
    assert adwin_merged_flags(frame(spark, {"s": [7.0] * 900}), ["price"]).count() == 0


def test_keys_fields_nulls_and_values_that_are_not_finite(spark):
    a, b = shifts(7, 900, 300), shifts(8, 1500, 500)
    odd = [x for i, v in enumerate(b) for x in ([v] if i % 50 else [v, None, math.nan, math.inf])]
    df = frame(spark, {"a": a, "b": odd}).withColumn("source", F.when(F.col("source") == "a", F.col("source")))
    got = adwin_merged_flags(df, ["price", "close"], grace_period=20, chunk=8).collect()
    finite = [f"b{i:06d}" for i, v in enumerate(odd) if v is not None and math.isfinite(v)]
    want = {f"a{i + 19:06d}" for i, *_ in plain(a[19:])} | {finite[i + 19] for i, *_ in plain(b[19:])}
    assert {r.event_id for r in got} == want and {r.field for r in got} == {"price"}
    assert {r.source for r in got if r.event_id >= "b"} == {None}
    assert adwin_merged_flags(df.limit(0), ["price"]).count() == 0
    assert adwin_merged_flags(frame(spark, {"s": [1.0] * 31}), ["price"], grace_period=1).count() == 0
    with pytest.raises(ValueError):
        adwin_merged_flags(df, ["price"], chunk=0)


def test_steps_of_any_cut_equal_one_run(spark):
    df = frame(spark, {"s": shifts(9, 1000, 300), "x": shifts(10, 50, 20)})
    engine = PatternEngine({"detectors": [{"name": "m", "type": "adwin", "source": "s", "config": {
        "fields": ["price"], "method": "merged", "grace_period": 30, "chunk": 8}}]})

    def found(patterns):
        details = {r.pattern_id: json.loads(r.details) for r in patterns.collect()}
        return {p: (d["price_prev_mean"], d["price_new_mean"]) for p, d in details.items()}

    want, got, states = found(engine.detect(df)), {}, {}
    assert len(want) >= 3
    for lo, hi in ((0, 10), (10, 45), (45, 46), (46, 700), (700, 10**6)):
        patterns, new = engine.step(df.filter(F.substring("event_id", 2, 6).cast("int").between(lo, hi - 1)), states)
        now = found(patterns)
        assert not now.keys() & got.keys()
        got |= now
        states = {d: {s: t.checkpoint() for s, t in series.items()} for d, series in new.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_walks_are_few_however_many_chunks_and_cuts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(adwin_merged, "materialize", lambda df: written.append(1) or rolling.materialize(df))
    vals = shifts(11, 9000, 700)
    want = plain(vals)
    assert len(want) >= 10
    got = adwin_merged_flags(frame(spark, {"s": vals}), ["price"], grace_period=1, chunk=2).collect()
    assert sorted(int(r.event_id[1:]) for r in got) == [w[0] for w in want]
    # cells, chunks, summaries, two tables a round and the last walk
    assert len(written) <= 4 + 2 * 3
