"""ADWIN for hot keys: windows of mergeable buckets, chunks of a key run in parallel.

The cut rule is that of ``detectors.adwin``; what differs is how the window is kept, so
that it no longer depends on one pass over the values:

* A *cell* is ``CELL`` consecutive values of a (key, field): their sum and squared
  deviations, aggregated by Spark like any group. The window is tested behind every full cell.
* The window holds cells ``[start, end)`` in buckets that lie on dyadic places: two
  neighbours of size L become one of 2L once ``PER_LEVEL * 2L`` cells lie behind them. So
  place e (L its largest power of two as a factor) is a bucket edge exactly if ``e - L < start``
  or ``end - e - L < 2 * PER_LEVEL * L``: buckets follow from start and end alone, and merging
  two runs of buckets gives what one pass would have given.
* Cuts are tested at all edges; while one holds, the oldest bucket goes. A bucket that lies d
  cells back has at most d / PER_LEVEL cells, so a cut sits within d / PER_LEVEL + 1 cells of the
  best place, and is found at most one cell (CELL values) later than by a test at each value.

Chunks of ``chunk`` cells are one row each, and run at the same time: a walk over the
chunks' summaries (about log n buckets each) gives every chunk the window it would start from,
chunks whose start is new are run again over their cells, and their cuts feed the next walk.
What a chunk found from another start counts only where the cut lies inside the chunk. The
walks end when no start changes, or after ``ROUNDS``: a last walk then carries the cells too
and runs the chunks whose start is still new as it comes to them. So there are at most
``ROUNDS`` + 1 walks however many chunks and cuts there are, and the result is that of one
sequential pass whatever the chunk size. A task holds one batch of chunks or one window at a time.

Values that are null, NaN or infinite are not fed. An event counts for the grace period if one
of its fields is fed; a key with less than a cell has no result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import numeric_field
from ..plans.rolling import materialize, null_safe_join, rows_index
from .common import ORDER
from .drift import drift_patterns
from .series import State

CELL = 32
PER_LEVEL = 4
CHUNK = 1024
# Walks with a run of all open chunks at once, before the walk that runs the rest itself.
ROUNDS = 3

_WINDOW = "pos array<long>, tot array<double>, m2 array<double>"
_AT = ["_k", "_f", "_c"]


class Window:
    """Buckets of the cells ``[start, end)``, oldest first: first cell, sum, squared deviations."""

    def __init__(self, end: int, pos: Sequence[int] = (), tot: Sequence[float] = (), m2: Sequence[float] = ()):
        self.end = int(end)
        self.pos, self.tot, self.m2 = [int(p) for p in pos], [float(v) for v in tot], [float(v) for v in m2]

    @property
    def start(self) -> int:
        return self.pos[0] if self.pos else self.end

    def parts(self) -> tuple[list[int], list[float], list[float]]:
        return self.pos, self.tot, self.m2

    def _merge(self, edge: int) -> None:
        """Make one bucket of the two beside ``edge``, which have the same size."""
        i = bisect_left(self.pos, edge)
        n = (edge - self.pos[i - 1]) * CELL
        self.m2[i - 1] += self.m2[i] + (self.tot[i - 1] - self.tot[i]) ** 2 / (2 * n)
        self.tot[i - 1] += self.tot[i]
        del self.pos[i], self.tot[i], self.m2[i]

    def add(self, total: float, m2: float) -> None:
        """The next cell. Only one edge of each size can end here."""
        self.pos.append(self.end)
        self.tot.append(total)
        self.m2.append(m2)
        self.end += 1
        size = 1
        while self.end % (2 * size) == 0:
            edge = self.end - (2 * PER_LEVEL + 1) * size
            if edge <= self.start:
                break
            if edge - size >= self.start:
                self._merge(edge)
            size *= 2

    def behind(self, other: "Window") -> "Window":
        """This window with the buckets of ``other``, which starts where this one ends."""
        out = Window(other.end, self.pos + other.pos, self.tot + other.tot, self.m2 + other.m2)
        gone = []
        for e in out.pos[1:]:
            size = e & -e
            if e - size >= out.start and out.end - e - size >= 2 * PER_LEVEL * size:
                gone.append((size, e))
        for _, e in sorted(gone):
            out._merge(e)
        return out

    def since(self, start: int) -> "Window":
        """The buckets from the edge ``start`` on."""
        i = bisect_left(self.pos, start)
        return Window(self.end, self.pos[i:], self.tot[i:], self.m2[i:])

    def has_cut(self, delta: float) -> bool:
        """Whether the two sides of some edge differ by more than the bound."""
        if len(self.pos) < 2:
            return False
        sizes = [(b - a) * CELL for a, b in zip(self.pos, [*self.pos[1:], self.end], strict=True)]
        width, total = (self.end - self.start) * CELL, sum(self.tot)
        mean = total / width
        var = sum(self.m2) / width + sum(n * (t / n - mean) ** 2 for n, t in zip(sizes, self.tot, strict=True)) / width
        ln = math.log(2.0 * math.log(width) / delta)
        n0, u0 = 0, 0.0
        for n, t in zip(sizes[:-1], self.tot, strict=False):
            n0 += n
            u0 += t
            n1 = width - n0
            m = 1.0 / n0 + 1.0 / n1
            if abs(u0 / n0 - (total - u0) / n1) > math.sqrt(2.0 * m * var * ln) + 2.0 / 3.0 * m * ln:
                return True
        return False

    def cut(self, delta: float) -> tuple[float, float, int] | None:
        """Drop the oldest buckets while a cut holds: mean of the dropped and of the kept
        values and the width kept, or None."""
        gone, first = 0.0, self.start
        while self.has_cut(delta):
            gone += self.tot.pop(0)
            del self.pos[0], self.m2[0]
        if self.start == first:
            return None
        width = (self.end - self.start) * CELL
        return gone / ((self.start - first) * CELL), sum(self.tot) / width, width


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunk rows to the buckets of their cells, as if no cut fell among them."""
    for pdf in batches:
        out = []
        for k, f, c, first, tots, m2s in pdf.itertuples(index=False, name=None):
            w = Window(first)
            for t, m in zip(tots.tolist(), m2s.tolist(), strict=True):
                w.add(t, m)
            out.append((k, f, c, first, w.end, *w.parts()))
        yield pd.DataFrame(out, columns=[*_AT, "first", "end", "pos", "tot", "m2"])


_RAN = ("_k string, _f string, _c long, ran_from long, start long, p1 array<long>, t1 array<double>, m1 array<double>, "
        "cell array<long>, prev_mean array<double>, new_mean array<double>, width array<long>")


def _run(w: Window, first: int, tots: Sequence[float], m2s: Sequence[float], delta: float) -> list:
    """A chunk over its cells from the window ``w`` before it, which becomes the one behind it:
    the start before and behind, the buckets where the latter lies inside the chunk, and the cuts."""
    ran_from, cuts = w.start, []
    for t, m in zip(tots, m2s, strict=True):
        w.add(t, m)
        found = w.cut(delta)
        if found:
            cuts.append((w.end - 1, *found))
    inside = [list(x) for x in w.parts()] if w.start > first else (None, None, None)
    return [ran_from, w.start, *inside, *[[x[i] for x in cuts] for i in range(4)]]


def _windows(batches: Iterator[pd.DataFrame], run=None) -> Iterator[tuple]:
    """From rows by (key, field, chunk): per batch what is known of each chunk that has to be run,
    (key, field, chunk, window before it, None) or, if ``run`` runs it at once, (..., its result);
    behind the last chunk of a key its window, with chunk None."""
    at, w = None, None
    columns = [*_AT, "first", "end", "pos", "tot", "m2", "ran_from", "start", "p1", "t1", "m1", *(["tots", "m2s"] if run else [])]
    for pdf in batches:
        out = []
        for k, f, c, first, end, pos, tot, m2, ran_from, start, p1, t1, m1, *cells in pdf[columns].itertuples(index=False, name=None):
            if (k, f) != at:
                if at is not None:
                    out.append((*at, None, w, None))
                at, w = (k, f), Window(first)
            if c < 0:  # the window of an earlier step
                w = Window(end, pos, tot, m2)
                continue
            ran = not pd.isna(ran_from)
            again = not ran or int(ran_from) != w.start
            if again and run:
                found = run(w, first, *[x.tolist() for x in cells])
                out.append((k, f, c, None, found))
                continue
            if again:
                out.append((k, f, c, Window(w.end, *w.parts()), None))
            if ran and start > first:
                w = Window(end, p1, t1, m1)
            else:
                if not again and start > w.start:
                    w = w.since(int(start))
                w = w.behind(Window(end, pos, tot, m2))
        yield out
    if at is not None:
        yield [(*at, None, w, None)]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The window before each chunk not yet run from that start, from the summaries and what
    the last run of a chunk found; with chunk null the window behind a key's last chunk."""
    for out in _windows(batches):
        yield pd.DataFrame([(k, f, c, w.end, *w.parts()) for k, f, c, w, _ in out], columns=[*_AT, "end", "pos", "tot", "m2"])


def _last_walk(delta: float):
    """The same walk over rows with their cells, which runs those chunks itself."""
    columns = [*_AT, "ran_from", "start", "p1", "t1", "m1", "cell", "prev_mean", "new_mean", "width", "end", "pos", "tot", "m2"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _windows(batches, lambda w, first, tots, m2s: _run(w, first, tots, m2s, delta)):
            rows = [(k, f, c, *found, None, None, None, None) if found else (k, f, c, *[None] * 9, w.end, *w.parts()) for k, f, c, w, found in out]
            yield pd.DataFrame(rows, columns=columns)
    return walk


def _run_chunks(delta: float):
    """Chunks over their cells from the window before them."""
    columns = [*_AT, "ran_from", "start", "p1", "t1", "m1", "cell", "prev_mean", "new_mean", "width"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, f, c, *_run(Window(first, pos, tot, m2), first, tots.tolist(), m2s.tolist(), delta))
                                for k, f, c, first, tots, m2s, pos, tot, m2 in pdf.itertuples(index=False, name=None)], columns=columns)
    return run


def _settle(chunks: DataFrame, before: DataFrame | None, delta: float) -> tuple[DataFrame, DataFrame]:
    """Walk and run chunks until no chunk's start changes, at most ``ROUNDS`` times, and a walk
    that runs the rest: the runs, and the windows behind the last chunks."""
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    summaries = chunks.mapInPandas(_summaries, f"_k string, _f string, _c long, first long, end long, {_WINDOW}")
    if before is not None:
        summaries = summaries.unionByName(before.select("_k", "_f", F.lit(-1).cast("long").alias("_c"), F.col("end").alias("first"), "end", "pos", "tot", "m2"))
    summaries = materialize(summaries)
    ran = spark.createDataFrame([], _RAN)
    for _ in range(ROUNDS):
        rows = summaries.join(ran.drop("cell", "prev_mean", "new_mean", "width"), _AT, "left")
        walked = materialize(rows.repartition(n, "_k", "_f").sortWithinPartitions(*_AT).mapInPandas(_walk, f"_k string, _f string, _c long, end long, {_WINDOW}"))
        todo = walked.filter("_c IS NOT NULL")
        if todo.isEmpty():
            return ran, walked.filter("_c IS NULL").drop("_c")
        fresh = chunks.join(todo.drop("end"), _AT).repartition(n, *_AT).select(*chunks.columns, "pos", "tot", "m2").mapInPandas(
            _run_chunks(delta), _RAN)
        ran = materialize(ran.join(todo.select(*_AT), _AT, "left_anti").unionByName(fresh))
    rows = summaries.join(ran.drop("cell", "prev_mean", "new_mean", "width"), _AT, "left").join(chunks.drop("first"), _AT, "left")
    last = materialize(rows.repartition(n, "_k", "_f").sortWithinPartitions(*_AT).mapInPandas(_last_walk(delta), f"{_RAN}, end long, {_WINDOW}"))
    fresh = last.filter("_c IS NOT NULL").select(*ran.columns)
    return ran.join(fresh.select(*_AT), _AT, "left_anti").unionByName(fresh), last.filter("_c IS NULL").select("_k", "_f", "end", "pos", "tot", "m2")


def _finite(df: DataFrame, field: str) -> Column:
    v = numeric_field(df, field)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _fed(df: DataFrame, state: State, fields: Sequence[str], grace_period: int, key: list[str], order: Sequence[str]):
    """Values behind the grace period with their number ``_at`` in their (key, field), the
    values of the open cells of an earlier step first; and the events seen per key."""
    values = [_finite(df, f).alias(f"_v{i}") for i, f in enumerate(fields)]
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                     F.col("event_id").cast("string").alias("event_id"), F.col("timestamp").cast("timestamp").alias("timestamp"),
                     F.col("source").cast("string").alias("source"), *values)
    rows = rows.filter(reduce(lambda a, b: a | b, [F.col(f"_v{i}").isNotNull() for i in range(len(fields))]))
    keys, orders = [f"_k{i}" for i in range(len(key))], [f"_o{i}" for i in range(len(order))]
    numbered = rows_index(rows, keys, orders, name="_n")
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
    if state.get("seen") is not None:
        numbered = null_safe_join(numbered, state["seen"], keys, how="left").withColumn("_n", F.col("_n") + F.coalesce("_seen", F.lit(0))).drop("_seen")
        seen = seen.unionByName(state["seen"]).groupBy(*keys).agg(F.sum("_seen").alias("_seen"))
    fed = numbered.filter(F.col("_n") >= grace_period).select(
        F.to_json(F.array(*[F.col(c).cast("string") for c in keys])).alias("_k"), *orders, "event_id", "timestamp", "source",
        F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f"_v{i}").alias("_x")) for i, f in enumerate(fields)])).alias("v"),
    ).select("_k", "v.*", *orders, "event_id", "timestamp", "source").filter(F.col("_x").isNotNull())
    fed = rows_index(fed, ["_k", "_f"], orders, name="_at").drop(*orders).withColumn("_at", F.col("_at").cast("long"))
    if state.get("fed") is not None:
        fed = fed.join(state["fed"], ["_k", "_f"], "left").withColumn("_at", F.col("_at") + F.coalesce("_fed", F.lit(0))).drop("_fed")
        fed = fed.unionByName(state["open"])
    return fed, seen


def _cuts(df: DataFrame, state: State | None, fields: Sequence[str], delta: float, grace_period: int, key: list[str],
          order: Sequence[str], chunk: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    if chunk < 1:
        raise ValueError(f"chunk must be positive: {chunk}")
    state = state or {}
    fed, seen = _fed(df, state, fields, grace_period, key, order)
    cell = F.floor((F.col("_at") - 1) / CELL).cast("long")
    cells = materialize(fed.groupBy("_k", "_f", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("tot"), (F.var_pop("_x") * CELL).alias("m2"),
        F.max_by(F.struct("event_id", "timestamp", "source"), "_at").alias("event")))
    full = cells.filter(F.col("n") == CELL)
    item = F.sort_array(F.collect_list(F.struct("cell", "tot", "m2")))
    chunks = materialize(full.groupBy("_k", "_f", F.floor(F.col("cell") / chunk).cast("long").alias("_c")).agg(item.alias("x")).select(
        *_AT, F.col("x")[0]["cell"].alias("first"), F.col("x.tot").alias("tots"), F.col("x.m2").alias("m2s")))
    ran, windows = _settle(chunks, state.get("windows"), delta)
    hits = ran.select("_k", "_f", F.explode(F.arrays_zip("cell", "prev_mean", "new_mean", "width")).alias("h")).select("_k", "_f", "h.*")
    hits = hits.join(full.select("_k", "_f", "cell", "event"), ["_k", "_f", "cell"]).select(
        F.col("_k").alias("key"), "event.source", F.col("_f").alias("field"), "event.event_id", "event.timestamp", "prev_mean", "new_mean",
        F.when(F.col("prev_mean") != 0, (F.col("new_mean") - F.col("prev_mean")) / F.abs("prev_mean") * 100).otherwise(0.0).alias("change_pct"), "width")
    part = cells.filter(F.col("n") < CELL)
    counts = cells.groupBy("_k", "_f").agg(F.max(F.col("cell") * CELL + F.col("n")).alias("_fed"))
    if state.get("fed") is not None:
        counts = counts.unionByName(state["fed"]).groupBy("_k", "_f").agg(F.max("_fed").alias("_fed"))
    left = fed.withColumn("cell", cell).join(part.select("_k", "_f", "cell"), ["_k", "_f", "cell"], "left_semi").drop("cell")
    return hits, {"seen": seen, "fed": counts, "open": left, "windows": windows}


def adwin_merged_flags(df: DataFrame, fields: Sequence[str], delta: float = 0.002, grace_period: int = 100,
                       key: Sequence[str] = ("source",), order: Sequence[str] = ORDER, chunk: int = CHUNK) -> DataFrame:
    """One row per (cell, field) whose test cut the window, with the cell's last event, the
    means of the dropped and of the kept values, their change and the width kept. ``chunk``
    (cells run by one task at a time) does not change the result."""
    return _cuts(df, None, fields, delta, grace_period, list(key), order, chunk)[0]


def adwin_merged_step(df: DataFrame, state: State | None, fields: Sequence[str], detector: str = "drift", delta: float = 0.002,
                      grace_period: int = 100, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER, chunk: int = CHUNK
                      ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Patterns of a step's rows, and for the next step the windows, the values of the open
    cells and the numbers of values and events."""
    hits, state = _cuts(df, state, fields, delta, grace_period, list(key), order, chunk)
    return drift_patterns(hits, fields, detector), state
