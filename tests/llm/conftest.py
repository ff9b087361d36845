import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    """Invented sentences of n words."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append(w + (rng.choice([". ", ".\n"]) if rng.random() < 0.15 else " "))
    return "".join(out).strip()


def edge_rows(rng):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = prose(rng, 30_000)
    rows = [(i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1)
            for i in range(40)]
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (None, "no id here. " * 8, "en", "b", 1),
             (None, None, None, None, None), (102, long, "en", "a", 1), (103, " \t\n\x0b ", None, None, 5)]
    rows += [rows[0], rows[0], (104, rows[1][1], "en", "a", 1), (105, rows[1][1], "en", "b", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(random.Random(5)), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like the operators' own and like their output."""
    from pyspark.sql import functions as F

    names = ["__k1", "__text", "__row", "__fp", "__n", "__src", "__id", "size", "copies", "shard", "kept", "n_removed",
             "host", "verdict", "component_id", "score", "units", "spans", "text2"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
