"""Exact top-k search by inner product over a pivot-distance index.

Components become floor(``SCALE`` * x), so scores are exact integers. With M the largest
norm, a vector v gets one more coordinate sqrt(M^2 - |v|^2) and a query none: all vectors
lie on one sphere, and the angle between query and vector falls as their inner product
grows. Angles obey the triangle inequality.

Index. Pivots are spread vectors of a bounded sample (farthest-first). Every vector is
keyed by its nearest pivot and the angle to it, sorted by both and cut into blocks of
bounded bytes (range partitions, so equal keys are cut too); in a block, runs of 512
vectors of one pivot are its annuli, each with its least and largest angle.

Search. A query q at angle t from a pivot can find a vector at angle s from that pivot
no nearer than |t - s|. First it expands the annuli of one block, the one nearest to its
own key, in the order of that bound, and stops when the bound passes its k-th best. Then
it is sent, with its k-th best, to all other blocks whose bound does not pass that, and
expands their annuli in the same way. Bounds are widened by ``SLACK``, far above rounding;
scores are integers below 2^53 in BLAS, else 64-bit products. So the result is exact.

Scale. Vectors equal to each other are one group, pre-aggregated to its k + 1 smallest ids:
a larger id of the same vector can never be among the k best of any query, as ties go to
the smaller. Equal query vectors are searched once, for k + 1 rows, from which each query row
leaves out itself. A block's vectors are in memory (``BLOCK_BYTES`` at most), queries stream
past it; results are k + 1 slim rows a query and block. Copies of queries are bounded by the
number of blocks, 128 until blocks are full.

Cases: vectors that are null, or hold a null, NaN or infinite component, take no part;
an empty vector has score 0 everywhere; shorter vectors are filled with zeros; components
beyond +-2^24 after scaling count as that; a row with null id is no query and comes last
among ties; rows that repeat id and vector are each others' candidates; a query with fewer
candidates than k gets all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, K = 1024, 10
LIMIT = 1 << 24
SAMPLE, PIVOTS = 4096, 32
ANNULUS = 512
BLOCKS, LEAST_ROWS = 128, 4096
BLOCK_BYTES = 64 << 20
QUERY_ROWS = 256
SLACK = 1e-6


# -- geometry ------------------------------------------------------------------------------

def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two int32 matrices."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return a.astype("i8") @ b.astype("i8").T


class Sphere:
    """Angles between vectors, queries and pivots on the sphere of radius ``norm``."""

    def __init__(self, pivots: np.ndarray, norm2: int):
        self.pivots, self.norm2 = pivots, max(norm2, 1)
        self.lift = np.sqrt(np.maximum(self.norm2 - (pivots.astype("f8") ** 2).sum(axis=1), 0.0))

    def to_vectors(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.norm2 - (v.astype("f8") ** 2).sum(axis=1), 0.0))
        return np.arccos(np.clip((dots(v, self.pivots) + lift[:, None] * self.lift) / self.norm2, -1, 1))

    def to_queries(self, q: np.ndarray) -> np.ndarray:
        return self.angle(q, dots(q, self.pivots))

    def angle(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Angle between queries and what has these scores (a row of scores a query)."""
        size = np.sqrt((q.astype("f8") ** 2).sum(axis=1) * self.norm2)
        size[size == 0] = 1.0
        return np.arccos(np.clip(score / size[:, None], -1, 1))


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first vectors of the sample, by angle."""
    x = sample.astype("f8")
    x = x / np.maximum(np.sqrt((x ** 2).sum(axis=1, keepdims=True)), 1e-12)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(pivots, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return sample[sorted(set(chosen))]


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Packed int32 vectors of ``dim`` components."""
    return np.frombuffer(b"".join(col.to_pylist()), "<i4").reshape(-1, dim) if len(col) else np.zeros((0, dim), "i4")


# -- tables --------------------------------------------------------------------------------

def quantised(df: DataFrame, ident: str, vec: str, scale: int) -> DataFrame:
    """``(id, v)`` of the rows that take part; v is an array of int."""
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = df.select(F.col(f"`{ident}`").cast("bigint").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v")).filter(
        x.isNotNull() & F.coalesce(fine, F.lit(False)))
    limit = F.lit(float(LIMIT))
    return held.select("id", F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, -limit), limit)).cast("int")).alias("v"))


def packed(df: DataFrame, dim: int) -> DataFrame:
    """``v`` as bytes of ``dim`` int32, filled with zeros."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "v"]
    at = df.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            m = np.zeros((len(sizes), dim), "<i4")
            row = np.repeat(np.arange(len(sizes)), sizes)
            m[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
            raw = m.tobytes()
            width = 4 * dim
            out = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*out, pa.array([raw[i:i + width] for i in range(0, len(raw), width)] if dim else [b""] * len(sizes),
                                                              pa.binary())], names=[*[n for n in b.schema.names if n != "v"], "v"])

    return df.mapInArrow(run, ", ".join([*fields, "v binary"]))


def block_rows(rows: int, dim: int) -> int:
    """Rows of a block: 1/128 of all, at least 4,096, at most what fits 64 MB."""
    return max(1, min(max(rows // BLOCKS, LEAST_ROWS), BLOCK_BYTES // (4 * max(dim, 1))))


def keyed(vectors: DataFrame, sphere, dim: int, of_queries: bool) -> DataFrame:
    """Adds ``pivot``, the nearest one, and ``angle`` to it."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sphere(*sphere.value)
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("v")), dim)
            far = s.to_queries(x) if of_queries else s.to_vectors(x)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype("i4")), pa.array(far[np.arange(len(near)), near])],
                                             names=[*b.schema.names, "pivot", "angle"])

    return vectors.mapInArrow(run, f"{fields}, pivot int, angle double")


# -- search --------------------------------------------------------------------------------

class Best:
    """The best rows so far of a batch of queries: score, id, same vector as the query."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor  # floor: a score that the k-th best reaches at least
        self.q = self.score = self.id = np.zeros(0, "i8")
        self.same = self.void = np.zeros(0, bool)
        self.n = queries

    def add(self, q, score, ident, same, void) -> None:
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        ident, same = np.concatenate([self.id, ident]), np.concatenate([self.same, same])
        void = np.concatenate([self.void, void])
        order = np.lexsort((ident, void, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.q, self.score, self.id, self.same, self.void = q[rank < self.k], score[keep], ident[keep], same[keep], void[keep]
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.floor[self.q[full]] = np.maximum(self.floor[self.q[full]], self.score[full])


class Block:
    """A block of the index: annuli of at most ``ANNULUS`` vectors of one pivot, by angle."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, pivot: np.ndarray, angle: np.ndarray):
        order = np.lexsort((angle, pivot))
        self.void = np.array(ids.is_null())[order]
        self.ids = ids.fill_null(0).to_numpy()[order]
        self.v, pivot, angle = vectors[order], pivot[order], angle[order]
        self.norm2 = (self.v.astype("i8") ** 2).sum(axis=1)
        cut = [0]
        for start, end in zip(*(lambda f: (f, np.append(f[1:], len(pivot))))(np.flatnonzero(np.diff(pivot, prepend=-1))), strict=True):
            cut += [*range(start + ANNULUS, end, ANNULUS), int(end)]
        self.cut = list(zip(cut[:-1], cut[1:], strict=True))
        first = np.array([s for s, _ in self.cut])
        last = np.array([e - 1 for _, e in self.cut])
        self.pivot, self.low, self.high = pivot[first], angle[first], angle[last]

    def search(self, sphere: Sphere, queries: np.ndarray, floor: np.ndarray, k: int) -> Best:
        """The k best rows of each query with at least the floor's score."""
        best = Best(len(queries), k, floor.copy())
        own = (queries.astype("i8") ** 2).sum(axis=1)
        away = sphere.to_queries(queries)[:, self.pivot]
        bound = np.maximum(np.maximum(self.low - away, away - self.high), 0.0)
        bound[own == 0] = 0.0  # all scores are zero
        reach = self._reach(sphere, queries, best.floor)
        for a in bound.min(axis=0).argsort(kind="stable").tolist():
            go = np.flatnonzero(bound[:, a] <= reach)
            if not len(go):
                if bound[:, a].min() > reach.max():
                    break
                continue
            s, e = self.cut[a]
            score = dots(queries[go], self.v[s:e])
            least = best.floor[go]
            if e - s > k:
                least = np.maximum(least, np.partition(score, e - s - k, axis=1)[:, e - s - k])
            i, j = np.nonzero(score >= least[:, None])
            q, hit = go[i], score[i, j]
            best.add(q, hit, self.ids[s + j], (hit == own[q]) & (self.norm2[s + j] == own[q]), self.void[s + j])
            reach = self._reach(sphere, queries, best.floor)
        return best

    @staticmethod
    def _reach(sphere: Sphere, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Angle beyond which nothing reaches the floor's score."""
        none = floor == np.iinfo("i8").min
        reach = sphere.angle(queries, np.where(none, 0, floor)[:, None])[:, 0] + SLACK
        reach[none | ~queries.any(axis=1)] = np.inf
        return reach


FOUND = "qid bigint, score bigint, id bigint, same boolean"


def visit(index: DataFrame, sent: DataFrame, sphere, dim: int, k: int) -> DataFrame:
    """Rows ``FOUND``: the best k of every query in every block it is ``sent`` to
    (``block, qid, v, floor``)."""
    rows = index.select("block", F.lit(0).alias("kind"), F.col("id").alias("a"), "v", "pivot", "angle")
    rows = rows.unionByName(sent.select("block", F.lit(1).alias("kind"), F.col("qid").alias("a"), "v", F.lit(0).alias("pivot"),
                                        F.col("floor").cast("double").alias("angle"), F.col("floor")), allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sphere(*sphere.value)
        at, kept, block = None, [], None
        for whole in batches:
            blocks = whole.column(0).to_numpy()
            kinds = whole.column(1).to_numpy()
            change = np.flatnonzero((np.diff(blocks, prepend=blocks[:1]) != 0) | (np.diff(kinds, prepend=kinds[:1]) != 0))
            for start, end in zip([0, *change.tolist()], [*change.tolist(), len(blocks)], strict=True):
                b = whole.slice(start, end - start)
                if not b.num_rows:
                    continue
                if at != blocks[start]:
                    at, kept, block = blocks[start], [], None
                if kinds[start] == 0:
                    kept.append((b.column(2), matrix(b.column(3), dim), b.column(4).to_numpy(), b.column(5).to_numpy()))
                    continue
                if block is None:
                    if not kept:  # no such block
                        continue
                    block = Block(pa.concat_arrays([x[0] for x in kept]), *[np.concatenate([x[i] for x in kept]) for i in (1, 2, 3)])
                    kept = []
                for i in range(0, b.num_rows, QUERY_ROWS):
                    some = b.slice(i, QUERY_ROWS)
                    floor = some.column(6).fill_null(np.iinfo("i8").min).to_numpy()
                    best = block.search(s, matrix(some.column(3), dim), floor, k)
                    yield pa.RecordBatch.from_arrays([
                        some.column(2).take(pa.array(best.q)), pa.array(best.score), pa.array(best.id, mask=best.void), pa.array(best.same)],
                        names=["qid", "score", "id", "same"])

    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = K, ident: str = "vec_id", vec: str = "embedding", scale: int = SCALE,
          pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` (a condition on
    ``id``) holds for, the k rows other than itself with the highest score, ties to the
    smaller id. ``sample`` rows, by hash order, give the pivots."""
    spark = df.sparkSession
    whole = quantised(df, ident, vec, scale)
    shape = whole.agg(F.max(F.size("v")).alias("dim"),
                      F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda s, c: s + c.cast("bigint") * c)).alias("norm2"),
                      F.count(F.lit(1)).alias("rows")).first()
    dim, rows = max(shape.dim or 0, 1), shape.rows
    vectors = packed(whole, dim)
    # the k + 1 smallest ids of every distinct vector; a hot vector is cut down in each task first
    w = Window.partitionBy(F.xxhash64("v"), "v").orderBy(F.asc_nulls_last("id"))
    index = vectors.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k + 1).drop("at")
    index = written(index)
    some = index.select(F.xxhash64("v", "id").alias("h"), "v").orderBy("h").limit(sample).collect()
    points = np.array([np.frombuffer(r.v, "<i4") for r in some], "i4").reshape(-1, dim)
    points = spread(points, pivots) if len(points) else np.zeros((1, dim), "i4")
    sphere = spark.sparkContext.broadcast((points, int(shape.norm2 or 0)))

    n_blocks = max(1, -(-rows // block_rows(rows, dim)))
    index = keyed(index, sphere, dim, False).repartitionByRange(n_blocks, "pivot", "angle", "v", "id")
    index = written(index.withColumn("block", F.spark_partition_id()))
    blocks = written(index.groupBy("block", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high")))

    asked = written(vectors.filter(is_query))
    queries = asked.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.count(F.lit(1)).alias("copies"))
    queries = written(keyed(queries.select(F.monotonically_increasing_id().alias("qid"), "h", "v"), sphere, dim, True))
    zero = F.col("v") == F.lit(bytes(4 * dim))

    # the block nearest to the query's own key
    gap = F.greatest(F.col("low") - F.col("angle"), F.col("angle") - F.col("high"), F.lit(0.0))
    home = queries.join(blocks, "pivot", "left").groupBy("qid").agg(F.min(F.struct(gap.alias("gap"), "block")).alias("b"))
    home = home.join(queries, "qid").select(F.coalesce("b.block", F.lit(0)).alias("block"), "qid", "v", F.lit(None).cast("bigint").alias("floor"))
    near = written(visit(index, home, sphere, dim, k + 1))
    # all other blocks that may hold something as good
    floor = near.groupBy("qid").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).select(
        "qid", F.when(F.col("c") > k, F.col("s")).alias("floor"))
    bounds = reachable(queries.join(floor, "qid", "left"), sphere, dim)
    far = bounds.join(blocks, "pivot").filter(
        zero | ((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from")))).groupBy("block", "qid").agg(
            F.count(F.lit(1)).alias("met"), F.any_value("v").alias("v"), F.any_value("floor").alias("floor"))
    far = far.join(home.select("block", "qid"), ["block", "qid"], "left_anti")
    found = _best(near.unionByName(visit(index, far, sphere, dim, k + 1)), k + 1)

    # every query row leaves out itself: the first entry with its id and vector
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score", "same"))).alias("l"))
    each = asked.withColumn("h", F.xxhash64("v")).join(queries.select("qid", "h", "v"), ["h", "v"]).select(F.col("id").alias("query_id"), "qid")
    own = F.array_min(F.transform(F.filter("l", lambda e: e["same"] & (e["id"] == F.col("query_id"))), lambda e: e["at"]))
    lists = each.join(lists, "qid").withColumn("own", own).select(
        "query_id", F.posexplode(F.slice(F.filter("l", lambda e: F.col("own").isNull() | (e["at"] != F.col("own"))), 1, k)).alias("i", "e"))
    return lists.select("query_id", (F.col("i") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))


def reachable(queries: DataFrame, sphere, dim: int) -> DataFrame:
    """A row per query and pivot: the angles ``from`` .. ``to`` around that pivot at which
    a vector may reach the query's ``floor`` (all angles without a floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sphere(*sphere.value)
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(i, QUERY_ROWS)
                q = matrix(b.column(1), dim)
                away = s.to_queries(q)
                reach = Block._reach(s, q, b.column(2).fill_null(np.iinfo("i8").min).to_numpy())[:, None]
                n, p = away.shape
                take = pa.array(np.repeat(np.arange(n), p))
                yield pa.RecordBatch.from_arrays([
                    *[c.take(take) for c in b.columns], pa.array(np.tile(np.arange(p, dtype="i4"), n)), pa.array((away - reach).ravel()),
                    pa.array((away + reach).ravel())], names=["qid", "v", "floor", "pivot", "from", "to"])

    return queries.select("qid", "v", "floor").mapInArrow(run, "qid bigint, v binary, floor bigint, pivot int, from double, to double")
