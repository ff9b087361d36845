"""Prefix trie of rebuilt conversations against a plain rebuild in Python."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from driftwise.llm import trie
from driftwise.llm.trie import combined, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def head(c):
    return zlib.crc32(str(c).encode()) % 4


def naive(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {c: own.get(c - int(abs(c) % 20 * (1 if c >= 0 else -1)), [])[:head(c)] + ts[head(c):] for c, ts in own.items()}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for k, members in nodes.items():
        below = [v for v in nodes if v[:len(k)] == k]
        kids = lambda n: sum(1 for v in nodes if len(v) == len(n) + 1 and v[:len(n)] == n)
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids(k), sum(kids(v) == 0 for v in below),
                    sum((len(nodes[v]) - 1) * words(v) for v in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    out = prefix_trie(df, base=lambda c: c - c % 20, head=lambda c: F.crc32(F.encode(c.cast("string"), "UTF-8")) % 4, **kw)
    return sorted((tuple(r) for r in out.collect()), key=str)


def conversations(rng):
    turns = [("user", "hello there"), ("assistant", "hello"), ("user", "a b  c"), ("user", ""), (None, None), ("assistant", "a b\nc")]
    rows = []
    for c in [*range(45), 60, 61, 62, -3, -7, -20, 1005, 1006]:
        if c % 20 or c % 3 == 0:
            rows += [(c, t, *rng.choice(turns[:3 if c % 2 else 6])) for t in range(rng.randint(0, 7))]
    rows += [(1005, None, "user", "first"), (None, 1, "user", "nobody's"), (70, 5, "a", "x"), (70, 5, "b", "y"), (70, 5, "b", "y")]
    rows += [(2, t, *turns[t % 3]) for t in range(10, 90)]  # long, over several partitions
    return rows


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(trie, "IDS_BITS", 1)
    rows = conversations(random.Random(3))
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == naive(rows)


def test_extra_columns_and_empty(spark):
    rows = conversations(random.Random(4))[:60]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit("x").alias(n) for n in ("conv", "c", "d", "k1", "n", "part", "words", "base")])
    assert run(clash) == naive(rows)
    assert run(df.limit(0)) == []


def test_equal_conversations_end_at_one_node(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(4)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == naive(rows) and len(got) == 5


def test_colliding_keys_are_found_out(spark):
    """The first attempt's keys name all turns alike, the second's mix up roles."""
    rows = conversations(random.Random(5))[:80] + [(3, 9, "x", "one"), (3, 10, "y", "one")]
    tried = []

    def keys(attempt):
        tried.append(attempt)
        if attempt == 0:
            return F.lit(1).cast("long"), F.lit(2).cast("long")
        if attempt == 1:
            return F.xxhash64("text"), F.lit(2).cast("long")
        return F.xxhash64("role", "text"), F.xxhash64("text", "role")

    assert run(spark.createDataFrame(rows, SCHEMA), keys=keys) == naive(rows)
    assert tried == [0, 1, 2]


def test_products_are_associative():
    a, b, c = (3, 5, 7, 11), (2, 2**30, 2**30 - 1, 9), (4, 1, 0, 8)
    assert combined(combined(a, b, 0), c, 0) == combined(a, combined(b, c, 0), 0)
