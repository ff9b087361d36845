"""Every row's shard and slot against a plain pass: cells, curve, hash order, cuts."""

import math

import pytest
import xxhash
from pyspark.sql import functions as F

from driftwise.llm.shard import BITS, hilbert_index, shard


def spark_hash(ident, text):
    """XXH64 of the id's eight bytes, whose result seeds that of the text; nulls are passed over."""
    h = 42
    if ident is not None:
        h = xxhash.xxh64_intdigest(ident.to_bytes(8, "little", signed=True), seed=h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), seed=h)
    return h & ((1 << 62) - 1)


def string_cells(values, top):
    known = [v.encode() for v in values if v is not None]
    lo, hi = min(known), max(known)
    skip = 0
    while skip < min(len(lo), len(hi)) and lo[skip] == hi[skip]:
        skip += 1
    number = lambda b: float(int.from_bytes(b[skip:skip + 7].ljust(7, b"\0"), "big"))
    a, b = number(lo), number(hi)
    return [0 if v is None else int((number(v.encode()) - a) / max(b - a, 1e-9) * top) for v in values]


def size_cells(values, top):
    a, b = (math.log2(1 + f(values)) for f in (min, max))
    return [max(0, min(top, math.floor((math.log(1 + v) / math.log(2) - a) / max(b - a, 1e-9) * top))) for v in values]


@pytest.mark.parametrize("shards", [5, 24])
def test_shards_equal_a_plain_pass(spark, docs, shards):
    grid = spark.range(1 << (3 * BITS)).select(*[F.shiftright("id", i * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(f"a{i}") for i in range(3)])
    curve = {(r.a0, r.a1, r.a2): r.h for r in hilbert_index(grid, ["a0", "a1", "a2"], BITS, "h").collect()}
    rows, top = docs.collect(), (1 << BITS) - 1
    points = zip(string_cells([r.lang for r in rows], top), string_cells([r.source for r in rows], top),
                 size_cells([len((r.text or "").encode()) + 8 for r in rows], top), strict=True)
    placed = sorted((curve[p], spark_hash(r.doc_id, r.text), str(r.doc_id), r.text or "") for p, r in zip(points, rows, strict=True))
    n, want = len(rows), []
    for rank, (at, _, ident, text) in enumerate(placed):
        s = max(k for k in range(shards) if k * n // shards <= rank)
        want.append((at, ident, text, s, rank - s * n // shards))
    for parts in (4, 8192):
        got = [(r.hilbert, str(r.doc_id), r.text or "", r.shard, r.slot) for r in shard(docs, shards=shards, parts=parts).collect()]
        assert sorted(got) == sorted(want)
