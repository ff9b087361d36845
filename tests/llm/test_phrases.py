"""Phrase mining against plain counts, and the guarantee of the summaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from driftwise.llm import phrases
from driftwise.llm.phrases import Grams, MisraGries, mine_phrases, slices


def naive(rows, min_count, top=2000, inside=100, longest=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cand.items():
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = any(100 * b >= inside * a for q, b in cand.items() if len(q) > len(p)
                         and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(rng, n=150):
    langs = ["en", "de", None, "und", ""]
    vocabulary = ["der", "The", "the", "Ärger", "x", "y", "z", "a b", "new\tyork", "san  Francisco", "日本", "e f", "q"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(rng.randint(0, 40))),
             rng.choice(langs)) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \t ", "en"), ("...", "xx"), ("y x " * 3000, "en"), rows[0], rows[0]]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in mine_phrases(df, **kw).collect())


def test_brute_force(spark):
    rows = corpus(random.Random(1))
    for kw in ({"min_count": 3}, {"min_count": 15, "top": 7, "inside": 70}):
        got = run(spark, rows, **kw)
        assert got == naive(rows, **kw) and len(got) > 8


def test_small_slices_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 64)
    monkeypatch.setattr(phrases, "ROWS", 7)
    monkeypatch.setattr(phrases, "FLUSH", 50)
    monkeypatch.setattr(phrases, "FLUSH_LOCAL", 90)
    monkeypatch.setattr(phrases, "PART_MASS", 1 << 6)
    monkeypatch.setattr(phrases, "TALLY", 30)
    monkeypatch.setattr(phrases, "PACK", 3)
    rows = corpus(random.Random(2), 60)
    assert run(spark, rows, min_count=6) == naive(rows, 6)


def test_one_phrase_is_a_third_of_all(spark):
    rng = random.Random(3)
    rows = [("over and over " * 40 + " ".join(str(rng.randint(0, 500)) for _ in range(200)), "en") for _ in range(30)]
    assert run(spark, rows, min_count=100) == naive(rows, 100)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([("a b " * 9, "en")], "text string, lang string")
    assert mine_phrases(df.limit(0)).collect() == []
    clash = df.select("*", *[F.lit("x").alias(n) for n in ("phrase", "a", "n", "rank", "__text", "k", "words")])
    assert sorted(tuple(r) for r in mine_phrases(clash, min_count=3).collect()) == naive([("a b " * 9, "en")], 3)
    assert [f.dataType.simpleString() for f in mine_phrases(df).schema.fields] == ["string", "bigint", "string", *["bigint"] * 5]


def test_long_product_is_exact(spark):
    """1000 * a * n and l * r beyond 64 bits, as decimals."""
    row = spark.range(1).select(F.lit(9 * 10**14).alias("a"), F.lit(10**17).alias("n"), F.lit(9 * 10**14).alias("l"), F.lit(10**15).alias("r"))
    got = row.select(F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(18,0)) "
                            "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")).first()[0]
    assert got == 1000 * 9 * 10**14 * 10**17 // (9 * 10**14 * 10**15)


def test_summary_keeps_everything_frequent():
    rng = np.random.RandomState(5)
    for threshold in (5, 40):
        stream = [np.unique(rng.zipf(1.3, 400).clip(max=5000).astype("u8"), return_counts=True) for _ in range(50)]
        total = Counter()
        summary = MisraGries(threshold, spare=1)
        for h, c in stream:
            total.update(dict(zip(h.tolist(), c.tolist(), strict=True)))
            summary.merge(h, c.astype("i8"))
            summary.settle()
        kept = dict(zip(summary.hashes.tolist(), summary.counts.tolist(), strict=True))
        assert summary.mass == sum(total.values()) and len(kept) <= summary.capacity and 0 < 2 * summary.lost < threshold
        assert all(h in kept for h, f in total.items() if f >= threshold)
        assert all(0 <= f - c <= summary.lost for h, c in kept.items() for f in [total[h]])
        reached = set(summary.reaching(threshold).tolist())
        assert {h for h, f in total.items() if f >= threshold} <= reached <= {h for h, f in total.items() if f >= threshold - summary.lost}


def test_words_of_a_slice():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["A b, c", "d"]), pa.array(["en", "en"])], names=["t", "l"])
    (lang, text), = slices(batch)
    g = Grams(lang, text, phrases.Hashing())
    assert g.phrases(np.arange(len(g)), 1) == [b"a", b"b", b"c", b"d"] and g.phrases(np.array([0]), 2) == [b"a b"] and g.inside(2).tolist() == [True, False, False]
    assert len(set(g.words().tolist())) == 4


def test_tally_of_colliding_hashes():
    """N-grams that share the first hash are still told apart."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x y x y y"]), pa.array(["en"])], names=["t", "l"])
    (lang, text), = slices(batch)
    g = Grams(lang, text, phrases.Hashing())
    at, second = np.arange(len(g)), g.words(1)
    for h1 in (np.full(len(g), 7, "u8"), g.words()):
        tally = phrases.Tally()
        for _ in range(2):
            tally.add(lang, 1, g, at, h1, second)
        got = Counter()
        for part, rows, counts in tally.packs(3):
            assert 0 <= part < 8
            for (_, _, p), f in zip(rows, counts, strict=True):
                got[p] += f
        assert got == {"x": 4, "y": 6}


def test_packed_hashes_keep_48_bits():
    h = np.array([0, 1 << 63, 0x123456789ABCDEF0, 2**64 - 1], "u8")
    assert (phrases.unpacked(phrases.packed(h)) == (h >> np.uint64(16) << np.uint64(16))).all()
