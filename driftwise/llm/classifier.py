"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with temperature-calibrated probabilities.

1. Random indexing. A token is a run of letters or digits or a run of one other
   character; it is hashed to one of ``BUCKETS`` rows. Every row has a fixed sparse index vector of
   ``NONZERO`` entries +-1 in ``DIMS`` dimensions, and its context vector is the sum of the
   index vectors of the tokens within ``REACH`` places, over all tokens of all
   documents. Each task adds up its own integer matrix (a fixed size, whatever the
   task's input) and the matrices are summed per row by Spark, so the counts cover the
   whole corpus and are equal in every rerun.
2. Pooling. A document is the mean and the standard deviation over its tokens of the
   context vectors (scaled to length one), one fixed-size vector for the whole text.
3. The network (tanh hidden layer, logistic output) is trained in numpy on the driver, on at
   most ``max_train`` labelled documents picked by a hash of their text; a fifth of them is kept
   apart for the temperature, which divides the logit so that the scores are probabilities.
4. Scores are computed in the tasks from the checkpointed vectors.

Inputs of a score are the text's tokens only. Labels are read for training rows alone.

Cases: null and empty texts have the zero vector and the score the network gives it;
repeated rows are scored alike; labels that are null, or repeated, or of unknown ids
are ignored (repeated equal ones count once; contradicting ones are left out); without
labels of both kinds every score is the share of label 1 (0.5 without labels); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 13
DIMS = 64
NONZERO = 4
REACH = 2
HIDDEN = 32
MAX_TRAIN = 20_000
EPOCHS = 60
SEED = 20240607
TOKEN = re.compile(r"[^\W_]+|([^\w\s]|_)\1*")


def tokens(text: str) -> list[str]:
    return [m.group() for m in TOKEN.finditer(text)]


def bucket_ids(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Rows of the text's tokens; ``known`` caches the hashes of a task's tokens."""
    out = []
    for t in tokens(text or ""):
        b = known.get(t)
        if b is None:
            b = zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS
            if len(known) < 500_000:
                known[t] = b
        out.append(b)
    return np.array(out, "i8")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector, fixed by the seed."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def add_contexts(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each token's row the index vectors of its neighbours; -1 stands between
    documents."""
    for d in range(1, REACH + 1):
        left, right = ids[:-d], ids[d:]
        both = (left >= 0) & (right >= 0)
        left, right = left[both], right[both]
        for own, other in ((left, right), (right, left)):
            flat = (own[:, None] * DIMS + places[other]).ravel()
            total += np.bincount(flat, signs[other].ravel(), minlength=total.size).astype("i8")


def context_matrix(texts: DataFrame) -> np.ndarray:
    """``(BUCKETS, DIMS)`` context vectors over all rows of the one text column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMS, "i8")
        known: dict[str, int] = {}
        held: list[np.ndarray] = []
        size = 0
        gap = np.full(REACH, -1)  # keeps documents apart

        for b in batches:
            for t in b.column(0):
                ids = bucket_ids(t.as_py(), known)
                held += [ids, gap]
                size += len(ids)
                if size >= 1 << 18:
                    add_contexts(total, np.concatenate(held), places, signs)
                    held, size = [], 0
        if held:
            add_contexts(total, np.concatenate(held), places, signs)
        table = total.reshape(BUCKETS, DIMS)
        rows = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(rows), 1024):
            part = rows[at:at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4"))] + [
                pa.array(table[part, d]) for d in range(DIMS)], names=["bucket", *[f"d{d}" for d in range(DIMS)]])

    fields = ", ".join(["bucket int"] + [f"d{d} bigint" for d in range(DIMS)])
    parts = texts.mapInArrow(run, fields)
    summed = parts.groupBy("bucket").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS)])
    got = summed.toPandas()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIMS))
    out[got["bucket"].to_numpy("i8")] = got[[f"d{d}" for d in range(DIMS)]].to_numpy("f8")
    return out


def unit_rows(context: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return np.divide(context, norm, out=np.zeros_like(context), where=norm > 0).astype("f4")


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the tokens' vectors, from the rows' counts."""
    if not len(ids):
        return np.zeros(2 * vectors.shape[1], "f4")
    rows, counts = np.unique(ids, return_counts=True)
    v, share = vectors[rows].astype("f8"), counts / len(ids)
    mean = share @ v
    spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    return np.concatenate([mean, spread]).astype("f4")


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``(__id, __text)`` to ``(__id, __vec)``."""
    kind = docs.schema["__id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS floats, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                pooled = [pool(bucket_ids(t.as_py(), known), shared.value) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(pooled), pa.list_(pa.float32()))],
                                                 names=["__id", "__vec"])

    return docs.mapInArrow(run, f"__id {kind}, __vec array<float>")


@dataclass
class Network:
    """Standardisation, two layers and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN) -> Network:
    """Adam on the mean log loss with a weight penalty; the last fifth of the rows
    sets the temperature."""
    rng = np.random.default_rng(SEED)
    x, y = x.astype("f8"), y.astype("f8")
    if len(y) < 10 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1),
                       np.zeros(1), float(np.log(share / (1 - share))))
    cut = len(y) - len(y) // 5
    centre, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-3
    z = (x - centre) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden),
         "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(cut)
        for at in range(0, cut, 64):
            rows = order[at:at + 64]
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            err = (sigmoid(h @ p["w2"] + p["b2"]) - y[rows]) / len(rows)
            back = np.outer(err, p["w2"]) * (1 - h * h)
            grad = {"w1": z[rows].T @ back + 1e-3 * p["w1"], "b1": back.sum(axis=0),
                    "w2": h.T @ err + 1e-3 * p["w2"], "b2": np.array([err.sum()])}
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(centre, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    if cut < len(y):
        logit, truth = net.logit(x[cut:]), y[cut:]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def classify(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality", threshold: float = 0.7,
             max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``. ``labels`` has the id and
    a 0/1 label; ``trainable`` is a condition on the id as ``__id`` that rows used for
    training meet. At most ``max_train`` labelled rows are used."""
    own = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    context = context_matrix(own.select("__text"))
    vec = materialize(document_vectors(own, unit_rows(context)))
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"))
    known = known.filter("__id IS NOT NULL AND __y IN (0, 1)").groupBy("__id").agg(
        F.min("__y").alias("__y"), F.max("__y").alias("__top")).filter("__y = __top").select("__id", "__y")
    if trainable is not None:
        known = known.filter(trainable)
    known = materialize(known)
    count = known.count()
    # a hash share of the ids about the bound, and of their rows (ids may repeat) the first by hash
    unit = F.xxhash64("__id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    picked = known.filter(unit < min(1.0, max_train / max(count, 1)))
    sample = vec.join(picked, "__id").select(F.xxhash64("__id", "__vec").alias("__h"), "__vec", "__y")
    sample = sample.orderBy("__h").limit(max_train).toPandas()
    x = np.array(sample["__vec"].tolist(), "f4").reshape(len(sample), 2 * DIMS)
    net = train(x, sample["__y"].to_numpy())
    kind = vec.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 2 * DIMS)
            score = np.clip(net.score(got.astype("f8")), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype("i4"))],
                                             names=["__id", "score", "predicted"])

    return vec.mapInArrow(run, f"__id {kind}, score double, predicted int").withColumnRenamed("__id", id_col)
