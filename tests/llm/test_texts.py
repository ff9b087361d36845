"""Line and span dedup, quality rules, licence scan and classifier."""

import random
import re
from collections import Counter
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.llm import classifier, license_scan, quality
from driftwise.llm.linededup import dedup_lines
from driftwise.llm.spandedup import dedup_spans, plain, sentences
from tests.llm.conftest import prose


def naive_runs(rows, split, form, lengths, joiner):
    """Later occurrences over all documents, in the order (id, position)."""
    docs = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda d: d[0])
    first, out = {}, {}
    for ident, text in docs:
        units = split(text or "")
        solid = [i for i, u in enumerate(units) if form(u)]
        forms = [form(units[i]) for i in solid]
        gone = set()
        for p, n in enumerate(lengths(forms)):
            if n and first.setdefault(tuple(forms[p:p + n]), (ident, p)) != (ident, p):
                gone.update(range(p, p + n))
        kept = joiner.join(u for i, u in enumerate(units) if i not in {solid[p] for p in gone})
        out[ident] = (kept if gone else text, len(solid), len(gone))
    return out


def shared(spark, docs):
    rng = random.Random(9)
    passage = ". ".join(prose(rng, 12).replace(".", "").replace("\n", " ") for _ in range(6)) + "."
    lines = "\n".join(prose(rng, 6).replace("\n", " ") for _ in range(5))
    rows = [(300 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 30) + "\n" + lines + "\n\n" + prose(rng, 9), "en", "a", 1)
            for i in range(12)]
    rows += [(400, "same\n" * 40, "en", "a", 1), (401, "a\n\nb\n \nc\nd", "en", "a", 1), (402, "a\nb\nc\nx", "en", "a", 1)]
    return docs.filter("doc_id is not null").unionByName(spark.createDataFrame(rows, docs.schema))


def test_line_dedup_equals_brute_force(spark, docs, empty, clashing):
    df = shared(spark, docs)
    want = naive_runs(df.collect(), lambda t: t.split("\n"), lambda u: u.strip(" \t\n\x0b\x0c\r"),
                      lambda u: [3] * max(0, len(u) - 2), "\n")
    got = dedup_lines(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id]
        assert sum(s["last"] - s["first"] + 1 for s in r.removed_spans) == r.n_removed
    assert sum(r.n_removed for r in got) > 60
    assert dedup_lines(empty).count() == 0 and dedup_lines(clashing).count() == clashing.count()


def test_span_dedup_equals_brute_force(spark, docs, empty, clashing):
    df = shared(spark, docs)

    def lengths(units):
        out = []
        for p in range(len(units)):
            n = next((n for n in range(2, len(units) - p + 1) if sum(u.count(" ") + 1 for u in units[p:p + n]) >= 16), 0)
            out.append(n)
        return out

    small = df.filter("doc_id <> 102")  # the quadratic reference skips the very long text
    want = naive_runs(small.collect(), sentences, plain, lengths, "")
    got = {r.doc_id: r for r in dedup_spans(small).collect()}
    for i, r in got.items():
        assert (r.text, r.n_sentences, r.n_removed) == want[i]
    hit = [r for i, r in got.items() if 301 <= i <= 311]
    assert all(r.n_removed >= 5 for r in hit) and got[300].n_removed == 0
    assert dedup_spans(df).count() == df.count()
    assert dedup_spans(empty).count() == 0 and dedup_spans(clashing).count() == clashing.count()


def test_sentences_join_to_the_text():
    for t in ("", "a", "a. b", "a.\n\n b?  c!\n", "\n\n", "x.y z", 'He said "no." Then', "a.  \n  b"):
        assert "".join(sentences(t)) == t


def naive_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    cov = {p + o for p, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for o in range(3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov))


def test_statistics_equal_brute_force(spark, docs, empty):
    rows = [(500, "a b c a b c a b c", "en", "a", 1), (501, "x " * 400, "en", "a", 1), (502, "a b a b a b", "en", "a", 1),
            (503, "é ü # * \u2028 𝄞 <a> | 5%\n\nq\nq\n q", "en", "a", 1), (504, "a b c x a b c", "en", "a", 1), (505, "a b", "en", "a", 1)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = quality.quality_rules(df)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == naive_stats(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert got.count() == df.count()
    assert quality.quality_rules(df, keep_columns=False).count() == df.count()
    assert quality.quality_rules(empty).count() == 0 and quality.reject(empty).columns == empty.columns


def test_repeated_windows_without_the_fast_path(spark):
    """The slow sort gives what the packed one gives."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)],
                               "id long, t string")
    for r in quality.text_stats(df, F.col("t")).collect():
        assert r["__repeat"] == naive_stats(r.t)[4]


def test_outliers_rejected_and_clean_kept(spark, clashing):
    rng = random.Random(6)
    rows = [(i, prose(rng, int(np.exp(rng.gauss(5.5, 0.6))) + 50), "en", rng.choice("abc"), 1) for i in range(240)]
    copy = rows[0][1]
    rows += [(1000 + i, copy, "en", "a", 1) for i in range(300)]  # copies fill most of a source
    junk = [(2000 + i, " ".join(w + "$%&" for w in prose(rng, 200).split()), "en", "a", 1) for i in range(8)]
    junk += [(2100 + i, " | ".join(prose(rng, 200).split()), "en", "b", 1) for i in range(8)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert all(not r.kept for i, r in got.items() if i >= 2000)
    assert all(r.kept for i, r in got.items() if i < 2000)
    kept = quality.reject(df)
    assert kept.columns == df.columns and kept.count() == 540
    assert quality.quality_rules(clashing).count() == clashing.count()


def cosine_scan(files, templates, threshold):
    """Exact cosines of every line, block and licence file."""
    def words(t):
        return [x for x in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if x]

    vocabulary = {w for _, t in templates for w in words(t)}
    df = Counter(w for _, t in files for w in set(words(t)) & vocabulary)
    n = len(files)
    idf = lambda w: log((1 + n) / (1 + df[w])) + 1 if w in vocabulary else log((1 + n) / 2) + 1
    vec = lambda t: {w: (1 + log(c)) * idf(w) for w, c in Counter(words(t)).items()}
    length = lambda v: sqrt(sum(x * x for x in v.values()))
    own = {}
    for i, (path, text) in enumerate(files):
        units = (text or "").split("\n") + re.split("\n[ \t\r]*\n", text or "")
        if path and re.search(license_scan.LICENCE_FILE, path):
            units.append(text or "")
        best = None
        for u in set(units):
            x = vec(u)
            for lic, t in templates:
                y = vec(t)
                if x and (c := sum(v * y.get(w, 0) for w, v in x.items()) / length(x) / length(y)) >= threshold - 1e-12:
                    best = max(best or (0, ""), (round(c, 9), lic))
        own[i] = best
    dirs = {}
    for i, (path, _) in enumerate(files):
        if own[i] and path and re.search(license_scan.LICENCE_FILE, path):
            d = tuple(path.split("/")[:-1])
            dirs[d] = max(dirs.get(d, (0, "")), own[i])
    out = []
    for i, (path, _) in enumerate(files):
        found, kind = own[i], "own" if own[i] else None
        if not found and path is not None:
            d = tuple(path.split("/")[:-1])
            at = next((d[:k] for k in range(len(d), -1, -1) if d[:k] in dirs), None)
            if at is not None:
                found, kind = dirs[at], "inherited"
        out.append((path, found[1] if found else None, round(found[0], 6) if found else None, kind))
    return out


def test_licence_scan_equals_brute_force(spark):
    rng = random.Random(8)
    t = [x for _, x in license_scan.TEMPLATES]
    files = [("LICENSE", t[0]), ("a/b/c.py", prose(rng, 50)), ("a/LICENSE.txt", "Copyright me\n\n" + t[11]), ("a/b/d.py", ""),
             ("a/b/e.py", None), ("x/y.py", "# Licensed under CC BY-NC 4.0\n" + prose(rng, 80)), ("x/COPYING", prose(rng, 20)),
             ("top.py", prose(rng, 5)), (None, t[7]), (None, prose(rng, 9)), ("a/z/licence-mit", t[10]), ("a/z/q/r.py", "the " * 500),
             ("a/z/q/r.py", "the " * 500), ("/abs/f.py", "x"), ("b//f.py", "Permission granted, free of charge, to any person"),
             ("a/z/LICENSE", "Released under the MIT License."), ("long.py", prose(rng, 20_000) + "\n" + t[7])]
    df = spark.createDataFrame([(p, x, 1) for p, x in files], "path string, text string, __k1 int")
    for threshold in (0.4, 0.6, 0.9):
        got = license_scan.scan_licences(df, threshold=threshold).collect()
        have = Counter((r.path, r.licence, None if r.cosine is None else round(r.cosine, 6), r.evidence) for r in got)
        assert have == Counter(cosine_scan(files, license_scan.TEMPLATES, threshold)), threshold
    assert license_scan.scan_licences(df.limit(0)).count() == 0
    assert license_scan.scan_licences(df, templates=()).filter("licence is not null").count() == 0


def test_classifier_learns_and_is_calibrated(spark, docs, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, 80)
        if not good:
            text = " ".join(w + "$$$" for w in text.split()) if i % 2 else " | ".join(text.split())
        rows.append((10_000 + i, text, "en", "a", 1))
        labels.append((10_000 + i, int(good)))
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    lab = spark.createDataFrame(labels + [(10_001, 1), (10_001, 0), (None, 1), (3, None), (99_999, 0)], "doc_id long, quality int")
    got = classifier.classify(df, lab, trainable=F.col("__id") % 4 != 2).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [(score[i], y) for i, y in labels if i % 4 == 2]
    ranks = [(a > b) for a, ya in held for b, yb in held if ya > yb]
    assert np.mean(ranks) > 0.97
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.08
    again = {r.doc_id: r.score for r in classifier.classify(df.repartition(5), lab, trainable=F.col("__id") % 4 != 2).collect()}
    assert again == pytest.approx(score, abs=1e-6)
    assert classifier.classify(empty, lab).count() == 0
    assert {r.score for r in classifier.classify(docs, lab.limit(0)).collect()} == {0.5}


def test_context_vectors_equal_a_plain_count(spark):
    texts = ["a b c a, b!", "a", "", None, "c c c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    places, signs = classifier.index_vectors()
    want = np.zeros((classifier.BUCKETS, classifier.DIMS))
    for t in texts:
        ids = classifier.bucket_ids(t, {})
        for i in range(len(ids)):
            for j in range(len(ids)):
                if i != j and abs(i - j) <= classifier.REACH:
                    want[ids[i], places[ids[j]]] += signs[ids[j]]
    assert (classifier.context_matrix(df) == want).all()
