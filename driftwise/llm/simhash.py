"""SimHash near-dedup by anchor-point covering.

A document's fingerprint has bit b set if more than half of the hashes of its word
shingles have it set. Two fingerprints are linked if at most ``MAX_BITS`` = 4 bits
differ, and documents linked directly or through others form a component.

Anchors. The 64 bits are dealt into six groups, and six projections take 31 bits
from three groups each, chosen so that any four differing bits leave at least one
projection with one difference at most (``projections`` verifies this for every way
four bits can fall). On 31 bits the perfect Hamming code is a covering code: every
point lies within radius 1 of exactly one code word, its anchor. A fingerprint is
replicated, per projection, to every anchor within the covering radius plus the
threshold of one, radius 2: its own anchor and, unless it is a code word itself, 15
others. If x and y differ in one bit of the projection, y is therefore among the
replicas at x's anchor. Per anchor, its own points are compared with all replicas by
the full 64 bits, so candidates lose no link and links are exact.

Scale: documents are first collapsed to distinct fingerprints, so exact copies never
meet. A replica is 17 bytes (projection and anchor, fingerprint, own-anchor mark); a
fingerprint has 94 on average, whatever its length. An anchor's points are compared
with all replicas there at once, and reduced on the spot to a forest over the anchor's members (n - 1 edges
at most, not all pairs). Components come from alternating large-star and small-star
steps over the edges, checkpointed each round; nothing is collected.

Cases: null and empty texts have no words and the zero fingerprint, linked like any
other; texts of fewer words than a shingle are one shingle; repeated rows share
fingerprint and component; null ids link but never name a component unless it has
no other; an empty table gives an empty result; extra columns are ignored, and by
``near_dedup`` kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize, packed, row_key

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BITS = 31  # of a projection: the length of the Hamming code with 5 check bits
GROUPS = (11, 11, 11, 11, 10, 10)
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))


@cache
def projections(max_bits: int = MAX_BITS) -> tuple[tuple[int, ...], ...]:
    """Bit numbers of each projection. Checked for every distribution of the
    differing bits over the groups: some triple holds one of them at most."""
    starts = np.concatenate([[0], np.cumsum(GROUPS)])
    for fall in combinations_with_replacement(range(len(GROUPS)), max_bits):
        if min(sum(g in t for g in fall) for t in TRIPLES) > 1:
            raise ValueError(f"no projection leaves at most one of {max_bits} differing bits")
    return tuple(tuple(int(b) for g in t for b in range(starts[g], starts[g + 1]))[:BITS] for t in TRIPLES)


# -- fingerprints ---------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a whole text (A-Z lower-cased, split at ASCII blanks)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    upto = [ends[min(i + shingle, len(words)) - 1] - 1 for i in range(n)]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], upto, strict=True)), "<u8", n)
    counts = np.zeros(64, "i8")
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "__text", shingle: int = SHINGLE) -> DataFrame:
    """Adds ``__fp`` (the 64 bits as a signed long) and drops the text."""
    keep = [f for f in docs.schema.fields if f.name != text_col]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["__fp bigint"])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), "u8", len(texts)).view("i8")
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp)], names=[*names, "__fp"])

    return docs.mapInArrow(run, fields)


# -- links ----------------------------------------------------------------------------

def _parity_masks() -> np.ndarray:
    """Mask c: the positions 1..31 whose number has bit c set."""
    return np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> c & 1) for c in range(5)], "u8")


def anchors(fp: np.ndarray, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(own, row, other)``: each fingerprint's own anchor, and the pairs (index of
    the fingerprint, anchor) of all other anchors within radius 2."""
    point = np.zeros(len(fp), "u8")
    for i, b in enumerate(bits):
        point |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    syndrome = np.zeros(len(fp), "u8")
    for c, m in enumerate(_parity_masks()):
        syndrome |= (np.bitwise_count(point & m).astype("u8") & np.uint64(1)) << np.uint64(c)
    flip = np.concatenate([[0], np.uint64(1) << np.arange(31, dtype="u8")]).astype("u8")  # of position s
    own = point ^ flip[syndrome]
    # two flipped positions i < j restore the syndrome if i ^ j equals it
    off = np.flatnonzero(syndrome)
    i = np.arange(1, 32, dtype="u8")[None, :]
    j = i ^ syndrome[off][:, None]
    good = (j > i)
    other = (point[off][:, None] ^ flip[np.broadcast_to(i, j.shape)] ^ flip[j])[good]
    return own, np.repeat(off, good.sum(axis=1)), other


def replicas(fps: DataFrame) -> DataFrame:
    """``(__a, __fp, __own)``: every fingerprint at every anchor within radius 2;
    ``__a`` is projection and anchor in one long."""
    takes = projections()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy().view("u8")
            for at in range(0, len(whole), 4096):
                fp = whole[at:at + 4096]
                for p, bits in enumerate(takes):
                    own, row, other = anchors(fp, bits)
                    tag = np.uint64(p) << np.uint64(BITS)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([own, other]).view("i8") | np.int64(tag)),
                        pa.array(np.concatenate([fp, fp[row]]).view("i8")),
                        pa.array(np.arange(len(own) + len(row)) < len(own))], names=["__a", "__fp", "__own"])

    return fps.select("__fp").mapInArrow(run, "__a bigint, __fp bigint, __own boolean")


def _forest(points: np.ndarray, seen: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that join ``points`` (an anchor's own) and ``seen`` (all its replicas) as
    their links within ``max_bits`` do: each point is compared with all of ``seen`` at
    once, and an edge is kept if it joins two parts that were apart."""
    part = np.arange(len(seen))
    edges: list[tuple[int, int]] = []
    for i in np.searchsorted(seen, points).tolist():
        near = np.bitwise_count(seen ^ seen[i]) <= max_bits
        for j in np.flatnonzero(near & (part != part[i])).tolist():
            if part[j] != part[i]:
                edges.append((i, j))
                part[part == part[j]] = part[i]
        if len(edges) == len(seen) - 1:
            break
    return edges


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(__x, __y)`` between fingerprints whose components are those of all
    links within ``max_bits``."""
    projections(max_bits)
    spread = replicas(fps).repartition("__a").sortWithinPartitions("__a")

    def compare(fp: np.ndarray, own: np.ndarray) -> tuple[list[int], list[int]]:
        points, seen = np.unique(fp[own]), np.unique(fp)
        if len(seen) < 2 or not len(points):
            return [], []
        found = _forest(points, seen, max_bits)
        return [int(seen[x]) for x, _ in found], [int(seen[y]) for _, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []  # columns of the anchor that goes on in the next batch
        out = pa.schema([("__x", pa.int64()), ("__y", pa.int64())])

        def judged(a: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(a)) + 1
            starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])
            xs, ys = [], []
            owned = np.add.reduceat(own.astype("i8"), starts)
            for s, e in zip(starts[(stops - starts > 1) & (owned > 0)].tolist(),
                            stops[(stops - starts > 1) & (owned > 0)].tolist(), strict=True):
                x, y = compare(fp[s:e], own[s:e])
                xs += x
                ys += y
            return pa.RecordBatch.from_arrays([pa.array(np.array(xs, "u8").view("i8")),
                                               pa.array(np.array(ys, "u8").view("i8"))], schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy().view("u8"),
                    b.column(2).to_numpy(zero_copy_only=False).astype(bool)]
            if left and left[0][0][0] != cols[0][0]:
                yield judged(*[np.concatenate(c) for c in zip(*left, strict=True)])
                left = []
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                head = [c[:last] for c in cols]
                whole = [np.concatenate(c) for c in zip(*left, head, strict=True)] if left else head
                yield judged(*whole)
                left = []
            left.append([c[last:] for c in cols])
        if left:
            yield judged(*[np.concatenate(c) for c in zip(*left, strict=True)])

    return spread.mapInArrow(run, "__x bigint, __y bigint")


def components(edges: DataFrame, x: str = "__x", y: str = "__y") -> DataFrame:
    """``(__node, __root)`` for every node of an edge: its component's smallest node.

    Large-star links a node's larger neighbours to its smallest neighbour, small-star
    its smaller ones; alternated until nothing changes they leave stars."""
    def canonical(df: DataFrame) -> DataFrame:
        return df.filter("__u <> __v").distinct()

    def with_least(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``df`` with the smallest ``__v`` of its ``__u``. The minima are cut off from
        the join, so that a hot node's rows can be split or meet them by broadcast."""
        least = materialize(df.groupBy("__u").agg(F.min("__v").alias("__m")))
        return df.join(F.broadcast(least) if is_small(least) else least, "__u"), least

    e = materialize(canonical(edges.select(F.greatest(x, y).alias("__u"), F.least(x, y).alias("__v"))))
    seen = None
    while True:
        both = e.select("__u", "__v").unionByName(e.select(F.col("__v").alias("__u"), F.col("__u").alias("__v")))
        near, _ = with_least(both)
        large = near.filter("__v > __u").select(F.col("__v").alias("__u"), F.least("__m", "__u").alias("__v"))
        hop, least = with_least(materialize(canonical(large)))
        small = hop.select(F.col("__v").alias("__u"), F.col("__m").alias("__v")).unionByName(
            least.select("__u", F.col("__m").alias("__v")))
        e = materialize(canonical(small))
        # the edges' count and a sum of their hashes tell whether a round changed them
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("__u", "__v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        seen = state
    return e.select(F.col("__u").alias("__node"), F.col("__v").alias("__root")).unionByName(
        e.select(F.col("__v").alias("__node"), F.col("__v").alias("__root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, __k1, __k2, __fp, component_id, __root)`` per row of ``docs``; the
    component's name is the smallest id in it, and ``__root`` its smallest fingerprint:
    names repeat where ids do or are all null, roots do not."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    k1, k2 = row_key(ident, text)
    own = docs.select(ident.alias("__id"), k1.alias("__k1"), k2.alias("__k2"), text.alias("__text"))
    slim = materialize(fingerprints(own, "__text", shingle))
    each = materialize(slim.groupBy("__fp").agg(F.min("__id").alias("__min")))
    nodes = materialize(components(links(each, max_bits)))
    named = each.join(nodes, each["__fp"] == nodes["__node"]).groupBy("__root").agg(F.min("__min").alias("__cid"))
    linked = nodes.join(named, "__root").select(F.col("__node").alias("__fp"), "__cid", "__root")
    names = each.join(linked, "__fp", "left").select(
        "__fp", F.coalesce("__cid", "__min").alias("component_id"), F.coalesce("__root", "__fp").alias("__root"))
    names = materialize(names)
    return slim.join(names, "__fp").select(F.col("__id").alias(id_col), "__k1", "__k2", "__fp", "component_id", "__root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per component: of the rows with its smallest id the one
    with the smallest key (of rows equal in id and text any one)."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    lead = found.filter(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
    best = materialize(lead.groupBy("__root").agg(F.min(F.struct("__k1", "__k2")).alias("__b"),
                                                  F.count(F.lit(1)).alias("__c")))
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    k1, k2 = row_key(ident, text)
    rows = docs.select(packed(docs), k1.alias("__k1"), k2.alias("__k2"))
    rows = rows.join(best.select("__b.__k1", "__b.__k2", "__c"), ["__k1", "__k2"])
    once = rows.filter("__c = 1").select("__row")
    # names shared by several rows may be rows repeated whole: one of each stays
    many = rows.filter("__c > 1").groupBy("__k1", "__k2").agg(F.first("__row").alias("__row")).select("__row")
    return once.unionByName(many).select("__row.*")

