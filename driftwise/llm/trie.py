"""Prefix trie of rebuilt conversations, by composable fingerprints of turn sequences.

A conversation is rebuilt from the first h turns of a base conversation and its own turns
behind its first h. Every distinct sequence of the first d rebuilt turns is a node.

Fingerprints form a monoid: a sequence of turns with elements t_1 .. t_n has (n, sum of
t_i * B^i), modulo three 31-bit primes, and (m, f) times (n, g) is (m + n, f + B^m * g). Prefix
products of the *stored* conversations are formed once; a base's head is one of them, an own
suffix is a quotient of two, and head times suffix is formed from the two numbers alone: no
rebuilt text or sequence exists anywhere. A rebuilt prefix is a slim row that refers to its
last stored turn (conversation, position) and carries its fingerprint, its parent's, and
the 128-bit key of that turn's role and text.

Equality is verified: all rows of a node must have one parent and refer to turns of one key, so
that by induction over depth they are one sequence of keys, and turns that share a key must
have one role and text, compared as text. If anything differs, all is done again with other
hash seeds.

Subtree sums need no walk over levels. A node belongs to its smallest member, whose nodes are a
path's lower end; so the sum over a node's subtree is the total of its members' own nodes
less what its owner has above it.

Scale. Turns are slim rows, range-partitioned by conversation and order, so that a hot
conversation is cut; a partition hands the product of its last conversation to the
next, a row a partition (the only thing the driver sees). Counts and sums are aggregated before
the shuffle; paths are summed in chunks of 4,096 depths. The ids that end at a node are joined in
chunks of 256 and streamed through SHA-256 in order, which only one task can do for a node.

Cases: rows without conv_id belong to no conversation; a null turn comes first, equal turns are
ordered by role, then by the content's hash; null role or text is empty; repeated rows are turns
each; a conversation without rebuilt turns ends at the root; an empty table has no nodes; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RUN, written

PRIMES = (2147483647, 2147483629, 2147483587)
CHUNK_BITS = 12
IDS_BITS = 8
TRIES = 8


# -- monoid ----------------------------------------------------------------------------

def bases(attempt: int) -> list[int]:
    rng = np.random.RandomState(41 + attempt)
    return [int(rng.randint(2**20, 2**30)) for _ in PRIMES]


def powers(base: int, exponents: np.ndarray, p: int) -> np.ndarray:
    """base^e mod p for each exponent, negative ones too; by repeated squaring."""
    e = exponents.astype("i8") % (p - 1)
    out, square = np.ones(len(e), "i8"), base % p
    while e.any():
        out = np.where(e & 1, out * square % p, out)
        square = square * square % p
        e >>= 1
    return out


def elements(k1: np.ndarray, k2: np.ndarray, j: int, p: int) -> np.ndarray:
    """The turn's element modulo the j-th prime; never 0."""
    u = (k1.view("u8") ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93) + k2.view("u8")
    u = (u ^ (u >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((u ^ (u >> np.uint64(29))) % np.uint64(p - 1)).astype("i8") + 1


def combined(left: tuple, right: tuple, attempt: int) -> tuple:
    """Product of two fingerprints (n, f1, f2, f3)."""
    return (left[0] + right[0], *[(f + pow(b, left[0], p) * g) % p
                                  for f, g, b, p in zip(left[1:], right[1:], bases(attempt), PRIMES, strict=True)])


# -- prefix products of the stored conversations -----------------------------------------

LOCAL = "part int, conv bigint, at bigint, k1 bigint, k2 bigint, words bigint, g1 bigint, g2 bigint, g3 bigint, e1 bigint, e2 bigint, e3 bigint"


def local_products(ordered: DataFrame, attempt: int) -> DataFrame:
    """Rows (part, conv, k1, k2, words) in order, with their position ``at`` in the
    partition's piece of the conversation, the piece's product so far (g) and the last
    factor of it (e)."""
    base = bases(attempt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, have = None, 0, [0, 0, 0]
        for b in batches:
            c = b.column(1).to_numpy()
            if not len(c):
                continue
            k1, k2 = b.column(2).to_numpy(), b.column(3).to_numpy()
            first = np.flatnonzero(np.diff(c, prepend=c[0]) != 0)
            starts = np.concatenate([[0], first])
            sizes = np.diff(np.append(starts, len(c)))
            goes_on = conv == c[0]
            at = np.arange(len(c)) - np.repeat(starts, sizes) + 1
            at[:sizes[0]] += n if goes_on else 0
            gs, es = [], []
            for j, p in enumerate(PRIMES):
                e = elements(k1, k2, j, p) * powers(base[j], at, p) % p
                run_ = np.concatenate([[0], np.cumsum(e)])  # below 2^31 rows times 2^31
                g = run_[1:] - np.repeat(run_[starts], sizes)
                g[:sizes[0]] += have[j] if goes_on else 0
                gs.append(g % p)
                es.append(e)
            conv, n, have = c[-1], int(at[-1]), [int(g[-1]) for g in gs]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(at), *b.columns[2:], *map(pa.array, gs), *map(pa.array, es)],
                                             names=[f.split()[0] for f in LOCAL.split(", ")])

    return ordered.mapInArrow(run, LOCAL)


def prefix_products(turns: DataFrame, attempt: int) -> DataFrame:
    """``conv, pos, k1, k2, words``, the product g1..g3 of the first ``pos`` turns and
    b1..b3 of those before."""
    spark = turns.sparkSession
    order = ["conv", "turn", "role", "k1", "k2"]
    slim = written(turns.select(*order, "words"))  # else finding the ranges reads all texts once more
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(local_products(ordered.select(F.spark_partition_id().alias("part"), "conv", "k1", "k2", "words"), attempt))
    last = local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"),
                                     F.max(F.struct("conv", "at", "g1", "g2", "g3")).alias("piece"))
    carried, before = [], None  # before: conversation and fingerprint that reach the end of the partition
    for r in sorted(last.collect(), key=lambda r: r.part):  # a row a partition
        piece = tuple(r.piece)[1:]
        goes_on = before is not None and before[0] == r.first
        if goes_on:
            f = before[1]
            carried.append((r.part, r.first, f[0], *f[1:], *[pow(b, f[0], p) for b, p in zip(bases(attempt), PRIMES, strict=True)]))
        before = (r.last, combined(before[1], piece, attempt) if goes_on and r.first == r.last else piece)
    names = ["part", "conv", "n0", "f1", "f2", "f3", "q1", "q2", "q3"]
    carry = spark.createDataFrame(carried, ", ".join(["part int", *[f"{n} bigint" for n in names[1:]]]))
    t = local.join(F.broadcast(carry), ["part", "conv"], "left")
    new, prev = [], []
    for j, p in enumerate(PRIMES, 1):
        g = F.when(F.col("n0").isNull(), F.col(f"g{j}")).otherwise((F.col(f"f{j}") + F.col(f"q{j}") * F.col(f"g{j}")) % p)
        e = F.when(F.col("n0").isNull(), F.col(f"e{j}")).otherwise(F.col(f"q{j}") * F.col(f"e{j}") % p)
        new.append(g.alias(f"g{j}"))
        prev.append(F.pmod(g - e, F.lit(p)).alias(f"b{j}"))
    return t.select("conv", (F.col("at") + F.coalesce("n0", F.lit(0))).alias("pos"), "k1", "k2", "words", *new, *prev)


# -- rebuilt prefixes --------------------------------------------------------------------

def shifted(convs: DataFrame, attempt: int) -> DataFrame:
    """Adds s1..s3 = B^(head - h): moves an own suffix behind its head."""
    base = bases(attempt)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in convs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = b.column(b.schema.get_field_index("head")).to_numpy() - b.column(b.schema.get_field_index("h")).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(powers(base[j], off, p)) for j, p in enumerate(PRIMES)]],
                                             names=[*b.schema.names, "s1", "s2", "s3"])

    return convs.mapInArrow(run, f"{fields}, s1 bigint, s2 bigint, s3 bigint")


def rebuilt(products: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], attempt: int) -> DataFrame:
    """A row per conversation and depth of its rebuilt form: ``c, d, ends``, fingerprint
    f1..f3, the parent's p1..p3, and the last turn's reference (ref_conv, ref_pos), key and words."""
    n = products.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = n.select("conv", "n", base(F.col("conv")).cast("bigint").alias("base"), F.greatest(F.lit(0), head(F.col("conv")).cast("bigint")).alias("h"))
    convs = convs.join(n.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    g = [f"g{j}" for j in (1, 2, 3)]
    marks = products.select("conv", "pos", *g)
    heads = marks.select(F.col("conv").alias("base"), F.col("pos").alias("head"), *[F.col(x).alias(f"h{x}") for x in g])
    skipped = marks.select("conv", F.col("pos").alias("h"), *[F.col(x).alias(f"o{x}") for x in g])
    convs = convs.join(heads, ["base", "head"], "left").join(skipped, ["conv", "h"], "left").na.fill(0, [f"{a}{x}" for a in "ho" for x in g])
    convs = written(shifted(convs.withColumn("depth", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), attempt))

    key = ["k1", "k2", "words"]
    own = products.join(convs.drop("n"), "conv").filter("pos > h")
    place = lambda x, j, p: (F.col(f"hg{j}") + F.pmod(F.col(f"{x}{j}") - F.col(f"og{j}"), F.lit(p)) * F.col(f"s{j}")) % p
    own = own.select(F.col("conv").alias("c"), (F.col("head") + F.col("pos") - F.col("h")).alias("d"), "depth",
                     *[place("g", j, p).alias(f"f{j}") for j, p in enumerate(PRIMES, 1)],
                     *[place("b", j, p).alias(f"p{j}") for j, p in enumerate(PRIMES, 1)],
                     F.col("conv").alias("ref_conv"), F.col("pos").alias("ref_pos"), *key)
    longest = convs.agg(F.max("head")).first()[0] or 0
    first = products.filter(F.col("pos") <= longest).withColumnRenamed("conv", "base")
    start = convs.filter("head > 0").select(F.col("conv").alias("c"), "base", "head", "depth").join(first, "base").filter("pos <= head")
    start = start.select("c", F.col("pos").alias("d"), "depth", *[F.col(f"g{j}").alias(f"f{j}") for j in (1, 2, 3)],
                         *[F.col(f"b{j}").alias(f"p{j}") for j in (1, 2, 3)], F.col("base").alias("ref_conv"), F.col("pos").alias("ref_pos"), *key)
    zero = F.lit(0).cast("bigint")
    root = convs.select(F.col("conv").alias("c"), zero.alias("d"), "depth", *[zero.alias(f"{x}{j}") for x in "fp" for j in (1, 2, 3)],
                        *[zero.alias(x) for x in ("ref_conv", "ref_pos", *key)])
    return own.unionByName(start).unionByName(root).withColumn("ends", F.col("d") == F.col("depth")).drop("depth")


NODE = ["d", "f1", "f2", "f3"]
CHECKED = ["k1", "k2", "p1", "p2", "p3"]


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """A row per node, with the least and largest of what must be one value in it."""
    return prefixes.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.min(x).alias(x) for x in CHECKED], *[F.max(x).alias(f"{x}_high") for x in CHECKED])


def consistent(nodes: DataFrame, turns: DataFrame) -> bool:
    """Whether every node has one parent and one last turn key, and every key that is
    met more than once one role and text."""
    if nodes.filter(" or ".join(f"{x} <> {x}_high" for x in CHECKED)).limit(1).count():
        return False
    met = turns.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("met")).filter("met > 1").select("k1", "k2")
    same = turns.join(met, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(
        *[f(x).alias(f"{x}_{f.__name__}") for x in ("role", "text") for f in (F.min, F.max)])
    return not same.filter("role_min <> role_max or text_min <> text_max").limit(1).count()


# -- trie ------------------------------------------------------------------------------------

def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of a node's conversation ids, ascending and joined by commas; the rows of a
    node pass one task in order, chunk by chunk."""
    chunk = F.shiftright("c", IDS_BITS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*NODE, chunk.alias("chunk")).agg(ids.alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            keys = list(zip(*[b.column(i).to_pylist() for i in range(4)], strict=True))
            for k, text in zip(keys, b.column(5).to_pylist(), strict=True):
                if k != node:
                    if digest is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            if done:
                yield rows(done)
        if digest is not None:
            yield rows([(*node, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])

    return ordered.mapInArrow(run, "d bigint, f1 bigint, f2 bigint, f3 bigint, ends_sha256 string")


def above(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Adds ``<value>_above``: the sum over the owner's nodes of lower depth."""
    chunked = nodes.withColumn("chunk", F.shiftright("d", CHUNK_BITS))
    sums = chunked.groupBy("conv_id", "chunk").agg(*[F.sum(v).alias(v) for v in values])
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "chunk", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_before") for v in values])
    inner = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    out = chunked.join(sums, ["conv_id", "chunk"])
    return out.select(*nodes.columns, *[(F.col(f"{v}_before") + F.coalesce(F.sum(v).over(inner), F.lit(0))).alias(f"{v}_above") for v in values])


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column],
                keys: Callable[[int], tuple[Column, Column]] | None = None) -> DataFrame:
    """The trie's nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, and
    ``ends_sha256`` of the members that end there.

    ``base`` and ``head`` give, for a conversation's id, the conversation its head comes
    from and the head's length. ``keys`` gives the two 64-bit keys of a turn's role and
    text for an attempt."""
    keys = keys or (lambda attempt: (F.xxhash64(F.lit(attempt), "role", "text"), F.xxhash64(F.lit(-1 - attempt), "text", "role")))
    stored = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                  F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    for attempt in range(TRIES):
        k1, k2 = keys(attempt)
        turns = stored.select("*", k1.alias("k1"), k2.alias("k2"), F.regexp_count("text", F.lit(WORD_RUN)).cast("bigint").alias("words"))
        prefixes = written(rebuilt(prefix_products(turns, attempt), base, head, attempt))
        nodes = written(nodes_of(prefixes))
        if consistent(nodes, turns):
            break
    else:
        raise RuntimeError("turn keys collide under every seed")

    parent = [F.col(f"p{j}").alias(f"f{j}") for j in (1, 2, 3)]
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), *parent).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, NODE, "left").na.fill(0, ["n_children"])
    full = written(full.select(*NODE, "conv_id", "n_convs", "n_children", "p1", "p2", "p3", (F.col("n_children") == 0).cast("bigint").alias("leaf"),
                               ((F.col("n_convs") - 1) * F.col("words")).alias("tokens")))
    own = full.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("tokens").alias("tokens"))
    sums = prefixes.select("c", *NODE).join(own.withColumnRenamed("conv_id", "c"), "c").groupBy(*NODE).agg(
        F.sum("leaf").alias("all_leaves"), F.sum("tokens").alias("all_tokens"))
    tops = full.select((F.col("d") + 1).alias("d"), *[F.col(f"f{j}").alias(f"p{j}") for j in (1, 2, 3)], F.col("conv_id").alias("parent_conv_id"))
    out = above(full, ["leaf", "tokens"]).join(sums, NODE).join(tops, ["d", "p1", "p2", "p3"], "left")
    out = out.join(ends_digest(prefixes.filter("ends").select("c", *NODE)), NODE, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                      (F.col("all_leaves") - F.col("leaf_above")).alias("n_leaves"), (F.col("all_tokens") - F.col("tokens_above")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
