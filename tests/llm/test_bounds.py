"""What the driver sees stays within the documented bound."""

import random

from driftwise.llm import classifier
from tests.llm.conftest import DOCS, prose


def test_training_rows_are_bounded_when_ids_repeat(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i % 30, prose(rng, 40), "en", "a", 1) for i in range(900)]
    seen = []
    plain = classifier.train
    monkeypatch.setattr(classifier, "train", lambda x, y, *a, **k: (seen.append(len(x)), plain(x, y, *a, **k))[1])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert classifier.classify(spark.createDataFrame(rows, DOCS), labels, max_train=20).count() == 900
    assert seen == [20]
