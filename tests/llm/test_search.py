"""Decontamination, SimHash and URL filter against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from driftwise.llm import simhash
from driftwise.llm.decontaminate import decontaminate, find_items
from driftwise.llm.url_filter import DigestArray, compile_index, filter_urls, filter_urls_by_join, split_url
from tests.llm.conftest import prose

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]


def grams(text, n=5):
    w = [x for x in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if x]
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set(), n


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(8, 60))) for i in range(20)]
    rows += [(20, None), (21, ""), (22, "tiny one"), (23, "zq"), rows[0], (0, "another text under the same id as item zero")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_items_found_as_by_brute_force(spark, docs, items, empty, clashing):
    rng = random.Random(2)
    lists = [r for r in items.collect()]
    planted = []
    for i, it in enumerate(lists[:20]):
        w = it.text.split()
        for k in range(0, len(w), 6):  # more and more words changed
            v = list(w)
            for j in rng.sample(range(len(w)), k // 6):
                v[j] = "changed"
            planted.append((1000 + 50 * i + k, prose(rng, 300) + " " + " ".join(v).upper() + " " + prose(rng, 40), "en", "a", 1))
    planted += [(5000, "here is a tiny one, and zq.", "en", "a", 1)]
    all_docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    want = set()
    for d in {(r.doc_id, r.text) for r in all_docs.collect()}:
        sets = {n: {tuple(x) for x in zip(*[re.sub(r"[\W_]+", " ", (d[1] or "").lower()).split()[i:] for i in range(n)], strict=False)}
                for n in range(1, 6)}
        for it in {(r.item_id, r.text) for r in lists}:
            own, n = grams(it[1])
            if own and len(own & sets[n]) >= 0.8 * len(own) - 1e-12:
                want.add((d[0], it[0], len(own & sets[n]), len(own)))
    got = find_items(all_docs, items).collect()
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == want and len(want) > 30
    bad = {r.doc_id for r in got}
    kept = decontaminate(all_docs, items)
    assert kept.columns == all_docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in all_docs.collect() if r.doc_id not in bad)
    assert find_items(empty, items).count() == 0
    assert find_items(all_docs, items.limit(0)).count() == 0
    assert find_items(all_docs, items.filter("item_id in (20, 21)")).count() == 0
    assert decontaminate(clashing, items).columns == clashing.columns


def naive_fingerprint(text):
    raw = (text or "").encode()
    w = raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not w:
        return 0
    n = min(4, len(w))
    hs = [xxhash.xxh64(b" ".join(w[i:i + n]), seed=42).intdigest() for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components(spark, docs, empty, clashing):
    rng = random.Random(3)
    base = [prose(rng, 400) for _ in range(6)]
    rows = []
    for i in range(120):
        w = base[i % 6].split()
        for j in rng.sample(range(len(w)), rng.randint(0, 6)):
            w[j] = "x"
        rows.append((2000 + i, " ".join(w), "en", "a", 1))
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    fps = defaultdict(list)
    truth = {(r.doc_id, r.text): naive_fingerprint(r.text) for r in df.collect()}
    for (i, _), f in truth.items():
        fps[f].append(i)
    assert sorted(str((r.doc_id, r["__fp"] % (1 << 64))) for r in got) == sorted(
        str((r.doc_id, truth[(r.doc_id, r.text)])) for r in df.collect())
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for f, ids in fps.items():
        known = [i for i in ids + [least[root(f)]] if i is not None]
        least[root(f)] = min(known) if known else None
    assert all(r.component_id == least[root(r["__fp"] % (1 << 64))] for r in got)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    assert simhash.near_dedup(clashing).columns == clashing.columns


def test_anchors_lose_no_pair():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 3000, dtype="u8")
    for p, bits in enumerate(simhash.projections()):
        assert len(bits) == simhash.BITS and len(set(bits)) == simhash.BITS, p
    found = np.zeros(len(fp), bool)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    for bits in simhash.projections():
        own, _, _ = simhash.anchors(fp, bits)
        own2, row, far = simhash.anchors(other, bits)
        found |= own == own2
        found[row[far == own[row]]] = True
    assert found.all()
    with pytest.raises(ValueError):
        simhash.projections(6)


def test_hot_anchor_keeps_components(spark):
    """Thousands of fingerprints around one centre: all within few bits of each other."""
    rng = np.random.default_rng(5)
    fps = {0}
    while len(fps) < 1500:
        v = 0
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            v |= 1 << int(b)
        fps.add(v - (1 << 64) if v >> 63 else v)
    df = spark.createDataFrame([(f,) for f in fps], "__fp long")
    nodes = simhash.components(simhash.links(df)).collect()
    assert len(nodes) == len(fps) and len({r["__root"] for r in nodes}) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "__x long, __y long")
    got = {r["__node"]: r["__root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def naive_verdict(url):
    host, path = split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    urls = ["http://a.example.org/es/1?x=/q", "https://EXAMPLE.org/en/12#t", "http://x.com/de/", "http://x.com/DE/", "x.com/de/",
            None, "", "http://", "://org/", "http://org", "http://org/", "http://myexample.org/es/2", "http://b.com/fr/a?b#c",
            "http://a/b://com/de/", "http://x.com?/de/", "http://ü.example.org/en/1", "http://x.net/", "http://x.com/de/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = [(i, *naive_verdict(u)) for i, u in enumerate(urls)]
    for f in (filter_urls, filter_urls_by_join):
        got = [tuple(r) for r in f(df, RULES).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
        assert got == want, f
        assert f(df.limit(0), RULES).count() == 0
        assert {r.verdict for r in f(df, []).collect()} == {"allow"}
    assert filter_urls(df, RULES, max_index_bytes=1).count() == len(urls)


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b, seed=0: 7)
    path = tmp_path / "index"
    path.write_bytes(compile_index([("block", f"h{i}.org", "/") for i in range(50)]))
    index = DigestArray(str(path))
    found = index.probe(["h3.org/", "h49.org/", "h50.org/"])
    assert found[2] == -1 and index.strings[int(index.offsets[found[0]]):int(index.offsets[found[0] + 1])].tobytes() == b"h3.org/"
