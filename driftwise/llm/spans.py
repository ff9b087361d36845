"""Repeated runs of text units (lines, sentences) across all documents: hashing of
runs, the global search for later occurrences, and rewriting of the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, row_key, with_columns, written

# A text's units; joined by the joiner they give the text again.
Split = Callable[[str], list[str]]
# The form in which units are compared; an empty form is no part of any run.
Form = Callable[[str], str]
# Runs as (start, length, units that wider runs add in front, the same behind).
Runs = Callable[[Sequence[str]], list[tuple[int, int, int, int]]]

SLICE = 256  # documents handled at once in a task


def run_hashes(docs: DataFrame, split: Split, form: Form, runs: Runs, wider: bool = False) -> DataFrame:
    """``(__id, __k1, __k2, __p, __len, __h1, __h2)``: a row per run, from ``(__id,
    __k1, __k2, __text)``. Positions count the units with content. If ``wider``, also
    ``__front`` and ``__behind``: hashes of the 1, 2, ... units next to the run."""
    kind = docs.schema["__id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            rows, starts, sizes, digests = [], [], [], []
            front, behind, fronts, behinds = [], [], [0], [0]
            for r, text in enumerate(b.column(3)):
                units = [u for u in map(form, split(text.as_py() or "")) if u]
                raw = [u.encode("utf-8", "surrogatepass") for u in units]
                for p, n, more, after in runs(units):
                    digests.append(xxhash.xxh3_128_digest(b"\n".join(raw[p:p + n])))
                    rows.append(r)
                    starts.append(p)
                    sizes.append(n)
                    if wider:
                        e = p + n
                        front += [xxhash.xxh3_64_digest(b"\n".join(raw[p - k:p])) for k in range(1, more + 1)]
                        behind += [xxhash.xxh3_64_digest(b"\n".join(raw[e:e + k])) for k in range(1, after + 1)]
                        fronts.append(len(front))
                        behinds.append(len(behind))
            take = pa.array(rows, pa.int64())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            arrays = [b.column(i).take(take) for i in range(3)] + [
                pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()),
                pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            if wider:
                arrays += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(more), "<i8")))
                           for ends, more in ((fronts, front), (behinds, behind))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["__id", "__k1", "__k2", "__p", "__len", "__h1", "__h2"] + (["__front", "__behind"] if wider else [])
    fields = f"__id {kind}, __k1 bigint, __k2 bigint, __p int, __len int, __h1 bigint, __h2 bigint"
    return docs.mapInArrow(hashed, fields + (", __front array<bigint>, __behind array<bigint>" if wider else ""))


def later_runs(units: DataFrame, keys: Sequence[str] = ("__h1", "__h2"), wider: bool = False) -> DataFrame:
    """``(__k1, __k2, __p, __len)`` of all runs that are not the first with their hash.

    The first is the one with the smallest id, key and position: a minimum with partial
    aggregation. Only hashes with two places go on to the join with the runs. If
    ``wider``, the same for the wider runs around those that repeat."""
    place = F.struct("__id", "__k1", "__p")
    first = units.groupBy(*keys).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__c"))
    repeated = first.filter("__c > 1").select(*keys, F.col("__first.__k1").alias("__fk"), F.col("__first.__p").alias("__fp"))
    met = (units if wider else units.drop("__id")).join(materialize(repeated), list(keys))
    if wider:
        met = written(met)
    later = met.filter("NOT (__k1 = __fk AND __p = __fp)").select("__k1", "__k2", "__p", "__len")
    if not wider:
        return later
    more = met.select("__id", "__k1", "__k2", "__p", "__len", "__h1", "__h2", F.explode(F.concat(
        F.transform("__front", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("front"), F.lit(0).alias("behind"))),
        F.transform("__behind", lambda h, i: F.struct(h.alias("h"), F.lit(0).alias("front"), (i + 1).alias("behind"))),
    )).alias("__m"))
    more = more.select("__id", "__k1", "__k2", (F.col("__p") - F.col("__m.front")).alias("__p"),
                       (F.col("__len") + F.col("__m.front") + F.col("__m.behind")).alias("__len"), "__h1", "__h2",
                       F.col("__m.h").alias("__h3"), (F.col("__m.front") - F.col("__m.behind")).alias("__side"))
    return later.unionByName(later_runs(more, ("__h1", "__h2", "__h3", "__side")))


def covered(runs: DataFrame) -> DataFrame:
    """``(__k1, __k2, __cov)``: the positions covered by a document's runs, merged."""
    each = runs.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("__p", "__len")).alias("__r"))
    places = F.flatten(F.transform("__r", lambda r: F.sequence(r["__p"], r["__p"] + r["__len"] - 1)))
    return each.select("__k1", "__k2", F.array_sort(F.array_distinct(places)).alias("__cov"))


def ranges(sorted_positions: Sequence[int]) -> list[tuple[int, int]]:
    """Sorted positions as ranges (first, last)."""
    out: list[tuple[int, int]] = []
    for p in sorted_positions:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def rewrite(text: str | None, cov: Sequence[int] | None, split: Split, form: Form, joiner: str
            ) -> tuple[str | None, int, list[dict]]:
    """The text without the covered units, its number of units with content, and the
    removed ranges."""
    units = split(text or "")
    solid = [i for i, u in enumerate(units) if form(u)]
    if cov is None or not len(cov):
        return text, len(solid), []
    gone = {solid[p] for p in cov}
    kept = joiner.join(u for i, u in enumerate(units) if i not in gone)
    return kept, len(solid), [{"first": a, "last": b} for a, b in ranges(sorted(cov))]


def dedup_units(docs: DataFrame, split: Split, form: Form, runs: Runs, joiner: str, unit: str, id_col: str,
                text_col: str, wider: bool = False) -> DataFrame:
    """``docs`` with the text rewritten, ``n_<unit>``, ``n_removed``, ``removed_spans``."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    k1, k2 = row_key(ident, text)
    own = docs.select(ident.alias("__id"), k1.alias("__k1"), k2.alias("__k2"), text.alias("__text"))
    hashes = written(run_hashes(own, split, form, runs, wider))
    cov = covered(later_runs(hashes, wider=wider))
    rows = docs.select(packed(docs), k1.alias("__k1"), k2.alias("__k2"))
    rows = rows.join(cov, ["__k1", "__k2"], "left").select("__row", "__cov")
    kind = rows.schema["__row"].dataType.simpleString()
    place = docs.columns.index(text_col)
    out = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            texts = pa.compute.cast(b.column(0).field(place), pa.string())
            done = [rewrite(t.as_py(), c.as_py(), split, form, joiner) for t, c in zip(texts, b.column(1), strict=True)]
            done = [(t, n, sum(s["last"] - s["first"] + 1 for s in gone), gone) for t, n, gone in done]
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array([d[i] for d in done], t) for i, t in enumerate(out)],
                names=["__row", "text", "units", "removed", "spans"])

    done = rows.mapInArrow(apply, f"__row {kind}, text string, units bigint, removed bigint, "
                                  "spans array<struct<first:int,last:int>>")
    return done.select(*with_columns(docs, {text_col: F.col("text"), f"n_{unit}": F.col("units"),
                                            "n_removed": F.col("removed"), "removed_spans": F.col("spans")}))
