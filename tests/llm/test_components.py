"""Components of null and repeated ids keep a row each."""

import random

from driftwise.llm.simhash import near_dedup
from tests.llm.conftest import DOCS, prose


def test_null_and_repeated_ids_keep_a_row_per_component(spark):
    rng = random.Random(31)
    texts = [prose(rng, 200) for _ in range(9)]
    near = " ".join(["x", *texts[0].split()[1:]])  # linked to the first text, and as it without an id
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7]), (None, texts[7])]
    rows += [(None, near), (None, texts[0]), (7, texts[4]), (9, texts[8])]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup(df).collect()), key=str)
    assert len(kept) == 9
    assert len([1 for i, t in kept if i is None and t in (texts[0], near)]) == 1
    assert {(i, t) for i, t in kept if t not in (texts[0], near)} == {
        *[(None, t) for t in texts[1:4]], *[(7, t) for t in texts[4:7]], (8, texts[7]), (9, texts[8])}
