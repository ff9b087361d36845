"""Exact ADWIN drift detection (Bifet & Gavalda, "Learning from Time-Changing Data
with Adaptive Windowing", SDM 2007), sequential per (key, field).

The window is kept as an exponential histogram (rows of buckets of 2^i items,
at most ``max_buckets`` per row), so state is O(log n) per key. Every ``clock``
items the window is tested at each bucket boundary; while the two sides'
means differ by more than

    eps = sqrt(2 m var ln(2/d')) + 2/3 m ln(2/d'),  m = 1/n0 + 1/n1,  d' = delta / ln(n)

the oldest bucket is dropped and a drift is reported for that item.

Batch form: rows are hash-partitioned by key and sorted by (key, order) inside
each partition; ``mapInPandas`` streams each partition through a dict of
per-key detectors (Arrow batches, bounded memory). Exactness needs one ordered
pass per key, so a key is one task: give keys enough granularity (e.g. symbol)
or use the window form ``detect_drift_adjacent``, which splits hot keys.
Streaming form: ``adwin_stream`` keeps the same state in ``applyInPandasWithState``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import numeric_field
from ..plans.rolling import materialize, null_safe_join, rows_index
from .common import ORDER, to_patterns
from .drift import drift_patterns
from .series import State


class Adwin:
    """ADWIN2 state machine for one stream."""

    def __init__(self, delta: float = 0.002, max_buckets: int = 5, min_window: int = 5, clock: int = 32,
                 grace: int = 10):
        self.delta, self.max_buckets, self.min_window, self.clock, self.grace = (
            delta, max_buckets, min_window, clock, grace)
        self.rows: list[list[list[float]]] = []  # rows[i] = buckets [total, var] of 2^i items, oldest first
        self.width = 0
        self.total = 0.0
        self.var = 0.0  # sum of squared deviations of the window
        self.seen = 0

    # -- state (for streaming) ------------------------------------------------
    def to_json(self) -> str:
        return json.dumps([self.rows, self.width, self.total, self.var, self.seen])

    @classmethod
    def from_json(cls, text: str, **kw) -> "Adwin":
        a = cls(**kw)
        a.rows, a.width, a.total, a.var, a.seen = json.loads(text)
        return a

    @property
    def mean(self) -> float:
        return self.total / self.width if self.width else 0.0

    def _insert(self, x: float) -> None:
        if self.width:
            self.var += self.width * (x - self.total / self.width) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        if not self.rows:
            self.rows.append([])
        self.rows[0].append([x, 0.0])
        i = 0
        while i < len(self.rows) and len(self.rows[i]) > self.max_buckets:
            (t1, v1), (t2, v2) = self.rows[i][0], self.rows[i][1]
            n = 2 ** i
            merged = [t1 + t2, v1 + v2 + n * n / (2 * n) * (t1 / n - t2 / n) ** 2]
            del self.rows[i][:2]
            if i + 1 == len(self.rows):
                self.rows.append([])
            self.rows[i + 1].append(merged)
            i += 1

    def _drop_oldest(self) -> tuple[int, float]:
        i = len(self.rows) - 1
        while not self.rows[i]:
            i -= 1
        t, v = self.rows[i].pop(0)
        n = 2 ** i
        if self.width > n:
            rest_mean = (self.total - t) / (self.width - n)
            self.var -= v + n * (self.width - n) / self.width * (t / n - rest_mean) ** 2
            self.var = max(self.var, 0.0)
        else:
            self.var = 0.0
        self.width -= n
        self.total -= t
        while self.rows and not self.rows[-1]:
            self.rows.pop()
        return n, t

    def update(self, x: float):
        """Add one value; returns None, or (prev_mean, new_mean) when a cut happened."""
        self._insert(float(x))
        self.seen += 1
        if self.seen % self.clock or self.width <= self.grace:
            return None
        dropped_n, dropped_t = 0, 0.0
        cut = True
        while cut and self.width > self.min_window * 2:
            cut = False
            n0, u0 = 0, 0.0
            var_w = self.var / self.width
            ln = math.log(2.0 * math.log(self.width) / self.delta)
            for i in range(len(self.rows) - 1, -1, -1):  # oldest rows first
                for t, _ in self.rows[i]:
                    n0 += 2 ** i
                    u0 += t
                    n1 = self.width - n0
                    if n1 < self.min_window:
                        break
                    if n0 < self.min_window:
                        continue
                    m = 1.0 / n0 + 1.0 / n1
                    eps = math.sqrt(2.0 * m * var_w * ln) + 2.0 / 3.0 * m * ln
                    if abs(u0 / n0 - (self.total - u0) / n1) > eps:
                        cut = True
                        break
                if cut or self.width - n0 < self.min_window:
                    break
            if cut:
                n, t = self._drop_oldest()
                dropped_n += n
                dropped_t += t
        if dropped_n:
            return dropped_t / dropped_n, self.mean
        return None


OUT_SCHEMA = "key string, source string, field string, event_id string, timestamp timestamp, prev_mean double, new_mean double, change_pct double, width long"


def _change_pct(old: float, new: float) -> float:
    return (new - old) / abs(old) * 100.0 if old != 0 else 0.0


def _run_partition(delta: float, grace_period: int, keep: bool = False):
    """Rows sorted by (key, field, order) through one detector after the other. A row with
    ``_state`` comes first and sets its detector up; with ``keep`` every detector's state
    is given out after its last row."""
    columns = ["key", "source", "field", "event_id", "timestamp", "prev_mean", "new_mean", "change_pct", "width"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a = None, Adwin(delta)

        def state():
            return (at[0], None, at[1], None, None, None, None, None, None, a.to_json())

        for pdf in batches:
            out = []
            for k, f, x, eid, ts, src, n, text in zip(*[pdf[c].tolist() for c in (
                    "_k", "_f", "_x", "event_id", "timestamp", "source", "_n", "_state")], strict=True):
                if (k, f) != at:
                    if keep and at is not None:
                        out.append(state())
                    at, a = (k, f), Adwin(delta)
                if text is not None:
                    a = Adwin.from_json(text, delta=delta)
                    continue
                if n < grace_period:  # the detector's n-th event: it is not fed yet
                    continue
                r = a.update(x)
                if r is not None:
                    out.append((k, src, f, eid, ts, r[0], r[1], _change_pct(r[0], r[1]), a.width, None))
            if out:
                yield pd.DataFrame(out, columns=[*columns, "state"])
        if keep and at is not None:
            yield pd.DataFrame([state()], columns=[*columns, "state"])
    return run


def _fed(df: DataFrame, fields: Sequence[str], key: Sequence[str], order: Sequence[str], number: Column) -> DataFrame:
    """A row per event and numeric field, with the event's ``number`` in its key."""
    kcol = F.to_json(F.array(*[F.col(c).cast("string") for c in key]))
    longs = None
    for f in fields:
        part = df.select(number.cast("long").alias("_n"), kcol.alias("_k"), F.lit(f).alias("_f"), numeric_field(df, f).alias("_x"),
                         F.col("event_id").cast("string").alias("event_id"), F.col("timestamp").cast("timestamp").alias("timestamp"), "source",
                         F.lit(None).cast("string").alias("_state"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
        part = part.filter(F.col("_x").isNotNull())
        longs = part if longs is None else longs.unionByName(part)
    return longs


def _run(longs: DataFrame, order: Sequence[str], delta: float, grace_period: int, partitions: int | None, keep: bool) -> DataFrame:
    n = partitions or int(longs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = longs.repartition(n, "_k", "_f").sortWithinPartitions(
        "_k", "_f", F.col("_state").isNull(), *[f"_o{i}" for i in range(len(order))])
    return ordered.select("_k", "_f", "_x", "event_id", "timestamp", "source", "_n", "_state").mapInPandas(
        _run_partition(delta, grace_period, keep), OUT_SCHEMA + ", state string")


def _with_a_field(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [numeric_field(df, f).isNotNull() for f in fields]))


def adwin_step(df: DataFrame, state: State | None, fields: Sequence[str], detector: str = "drift", delta: float = 0.002,
               grace_period: int = 100, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER
               ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Exact ADWIN over the rows of a step: patterns, and for the next step the windows
    (exponential histograms) and the events seen per key."""
    key, state = list(key), state or {}
    df = _with_a_field(df, fields)
    number, seen = F.col("_n"), df.groupBy(*key).agg(F.count(F.lit(1)).alias("_seen"))
    numbered = rows_index(df, key, order, name="_n")
    if state.get("seen") is not None:
        numbered = null_safe_join(numbered, state["seen"], key, how="left")
        number = F.col("_n") + F.coalesce("_seen", F.lit(0))
        seen = seen.unionByName(state["seen"]).groupBy(*key).agg(F.sum("_seen").alias("_seen"))
    longs = _fed(numbered, fields, key, order, number)
    if state.get("windows") is not None:
        longs = longs.unionByName(state["windows"].select(F.col("key").alias("_k"), F.col("field").alias("_f"), F.col("state").alias("_state")),
                                  allowMissingColumns=True)
    ran = materialize(_run(longs, order, delta, grace_period, None, keep=True))
    hits = ran.filter("state IS NULL").drop("state")
    return drift_patterns(hits, fields, detector), {"seen": seen, "windows": ran.filter("state IS NOT NULL").select("key", "field", "state")}


def adwin_flags(
    df: DataFrame,
    fields: Sequence[str],
    delta: float = 0.002,
    grace_period: int = 100,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    partitions: int | None = None,
) -> DataFrame:
    """One row per (event, field) where ADWIN cut its window."""
    key = list(key)
    # events of the detector: rows with at least one of its fields, numbered per key
    numbered = rows_index(_with_a_field(df, fields), key, order, name="_n")
    return _run(_fed(numbered, fields, key, order, F.col("_n")), order, delta, grace_period, partitions, keep=False).drop("state")


def detect_drift_adwin(
    df: DataFrame,
    fields: Sequence[str],
    detector: str = "drift",
    delta: float = 0.002,
    grace_period: int = 100,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Drift patterns from exact ADWIN (one per event with >= 1 drifting field)."""
    fl = adwin_flags(df, fields, delta, grace_period, key, order)
    return drift_patterns(fl, fields, detector)
