"""Licence cosines with the document frequencies of all words."""

import random
import re
from collections import Counter
from math import log, sqrt

import pytest

from driftwise.llm import common, license_scan


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def cosine(line, files, template):
    df = Counter(w for _, t in files for w in set(words(t)))
    vec = lambda t: {w: (1 + log(c)) * (log((1 + len(files)) / (1 + df[w])) + 1) for w, c in Counter(words(t)).items()}
    x, y = vec(line), vec(template)
    return sum(v * y.get(w, 0) for w, v in x.items()) / sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 0])
def test_common_words_of_a_notice_weigh_little(spark, monkeypatch, rows):
    rng = random.Random(41)
    notice = "This nice little project code is released under the MIT License."
    rare = "Quagga zebu released under the MIT License."
    files = [(f"d{i}/f{i}.txt", " ".join(rng.sample("this nice little project code is under the it and".split(), 9))) for i in range(300)]
    files += [("a/x.py", notice), ("b/y.py", rare), ("c/z.py", "x\n" + rare + " Okapi gnu ibex kudu eland oryx.")]
    monkeypatch.setattr(license_scan, "is_small", lambda df: common.is_small(df, rows))
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: r for r in license_scan.scan_licences(df).filter("path like '_/%'").collect()}
    template = "Released under the MIT License."
    assert got["a/x.py"].licence == "MIT" and got["a/x.py"].cosine == pytest.approx(cosine(notice, files, template))
    for path, line in (("b/y.py", rare), ("c/z.py", files[-1][1][2:])):
        want = cosine(line, files, template)
        assert (got[path].licence == "MIT") == (want >= 0.6)
        assert got[path].licence is None or got[path].cosine == pytest.approx(want)
