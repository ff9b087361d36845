"""Span dedup: every run length, tails, long sentences, passages inside other prose."""

import random

from driftwise.llm.spandedup import dedup_spans, plain, sentences


def naive_all_runs(docs, min_words=16):
    """The text that is left if all runs of at least 16 words are looked up."""
    first, out = {}, {}
    for ident, text in sorted(docs):
        units = sentences(text)
        solid = [i for i, u in enumerate(units) if plain(u)]
        forms = [plain(units[i]) for i in solid]
        gone = set()
        for p in range(len(forms)):
            for e in range(p + 1, len(forms) + 1):
                if sum(u.count(" ") + 1 for u in forms[p:e]) >= min_words:
                    if first.setdefault(tuple(forms[p:e]), (ident, p)) != (ident, p):
                        gone.update(range(p, e))
        out[ident] = "".join(u for i, u in enumerate(units) if i not in {solid[p] for p in gone})
    return out


def fresh(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def left(spark, docs):
    return {r.doc_id: r.text for r in dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_all_run_lengths(spark):
    rng = random.Random(21)
    pool = [fresh(rng, rng.choice([1, 2, 5, 9, 15, 16, 30])) + rng.choice([". ", "\n"]) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(80)]
    assert left(spark, docs) == naive_all_runs(docs)


def test_tail_of_a_passage(spark):
    passage = ". ".join([fresh(random.Random(1), 15), "one two three four", "five six"]) + ". "
    got = left(spark, [(1, passage + "Here is the end of it all."), (2, passage + "Another end comes there now.")])
    assert got[2] == "Another end comes there now."


def test_passages_inside_other_prose(spark):
    """50 words: one long sentence, one line, two sentences between foreign words."""
    rng = random.Random(22)
    docs, passages = [], []
    for k in range(30):
        w = fresh(rng, 50).split()
        if k % 3 == 1:
            w[rng.randint(5, 44)] += "."
        if k % 3 == 2:
            for j in (12, 25, 33):
                w[j] += "."
        passages.append(w)
        around = (lambda n: fresh(rng, n)) if k % 2 else (lambda n: fresh(rng, n) + "\n")
        docs += [(10 * k + i, around(rng.randint(0, 60)) + " " + " ".join(w) + " " + fresh(rng, rng.randint(0, 60))) for i in range(3)]
    got = left(spark, docs)
    runs = {}
    for ident, text in got.items():
        w = text.split()
        for i in range(len(w) - 49):
            assert runs.setdefault(tuple(w[i:i + 50]), ident) == ident
    for k, w in enumerate(passages):
        for i in (1, 2):
            stay = [x for x in got[10 * k + i].split() if x in w]
            assert len(stay) <= 32
        assert got[10 * k] == docs[3 * k][1]
