"""Mixing and sharding against plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftwise.llm.mix import mix, source_targets, take
from driftwise.llm.shard import hilbert_index, shard


def targets(sizes, weights, cap=3.0):
    """Water filling by rounds."""
    left, out = dict(sizes), {}
    total = float(sum(sizes.values()))
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > cap * sizes[s]]
        if not over:
            return out | {s: total * weights[s] / w for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
            del left[s]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000, None: 3}, {"a": 1}, {"a": 0, "b": 50, "c": 2, "d": 7},
                                   {"a": 100, "b": 100}, {"a": 0}])
def test_targets_equal_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "__src string, __size long")
    got = {r["__src"]: r["__target"] for r in source_targets(df, (1, 2, 3), 3).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = targets(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    assert got == pytest.approx(want)


def test_mix_edges(spark, docs, clashing, empty):
    got = mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == docs.count()
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").split())
    taken, target = Counter(), {}
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    biggest = max(r.size for r in got if r.size < 10_000)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(biggest, 30_000 if s == "a" else 0)
    again = mix(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter(r.copies for r in mix(clashing).select("copies").collect()) == Counter(r.copies for r in got)
    assert mix(clashing).columns.count("size") == 1
    assert mix(empty).count() == 0


def test_mix_comes_near_and_expands(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws("", F.lit("s"), F.col("id") % 4).alias("source"),
                                  F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 37 + 1).cast("int")), " ").alias("text"))
    got = mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"),
                                        F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()
    for r in got:
        assert abs(r.n - r.t) <= 2 and r.hi - r.lo <= 1
    mixed = mix(df)
    assert take(df).count() == mixed.agg(F.sum("copies")).first()[0] and take(df).columns == df.columns
    odds = df.withColumn("odds", F.when(F.col("doc_id") % 8 < 4, 9.0).otherwise(1.0))
    by = {r[0]: r[1] for r in mix(odds, weights=(1, 1, 1, 1, 1), total=20_000, odds_col="odds").groupBy(
        (F.col("doc_id") % 8 < 4)).agg(F.avg("copies")).collect()}
    assert by[True] > 2 * by[False]  # unequal inclusion


def test_shard_law_and_slots(docs, clashing, empty):
    for df in (docs, clashing):
        got = shard(df, shards=7).select("doc_id", "text", "size", "text_crc32", "shard", "slot", "hilbert").collect()
        rows = df.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in got)
        slots = defaultdict(list)
        for r in got:
            raw = (r.text or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
            slots[r.shard].append((r.slot, r.hilbert))
        assert sorted(slots) == list(range(7))
        for s in slots.values():
            assert sorted(x for x, _ in s) == list(range(len(s)))
        counts = [len(s) for s in slots.values()]
        assert max(counts) - min(counts) <= 1
        along = [h for s in sorted(slots) for _, h in sorted(slots[s])]
        assert along == sorted(along)
    assert shard(empty).count() == 0
    few = docs.filter("doc_id between 1 and 3")
    assert sorted(r.slot for r in shard(few, shards=24).collect()) == [0, 0, 0]


def test_hilbert_curve_steps_by_one(spark):
    for dims, bits in ((2, 3), (3, 3)):
        axes = [f"a{i}" for i in range(dims)]
        df = spark.range(1 << (dims * bits)).select(
            *[(F.shiftright("id", i * bits).bitwiseAND(F.lit((1 << bits) - 1))).cast("int").alias(a) for i, a in enumerate(axes)])
        pts = [r for r in hilbert_index(df, axes, bits, "h").orderBy("h").collect()]
        assert [r.h for r in pts] == list(range(len(pts)))
        for p, q in zip(pts, pts[1:], strict=False):
            assert sum(abs(p[a] - q[a]) for a in axes) == 1
