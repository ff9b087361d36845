"""Documented tier-2 operators: a second drift detector and its agreement with the
first, factor screening, bootstrap intervals, retention and replay of a window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rolling import Frame, materialize, null_safe_join, over_rows, rows_index
from ..sources.replay import replay
from .timeseries import running

ORDER = ("timestamp", "event_id")


def ddm_flags(df: DataFrame, error: str, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER,
              warning: float = 2.0, drift: float = 3.0, min_rows: int = 30) -> DataFrame:
    """Drift detection method (Gama et al., 2004) on a 0/1 ``error`` column: with p the
    error rate so far and s = sqrt(p (1 - p) / n), ``level`` is ``drift`` where p + s
    exceeds the smallest p + s so far by ``drift`` times s there (``warning`` likewise),
    else ``normal``. The rate is not restarted after a drift, so rows are flagged as long
    as it stays high. Cumulative values come from chunk totals, so a hot key is split."""
    rows = df.filter(F.col(error).isNotNull())
    rows = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_e", F.col(error).cast("long"))
    out = running(running(rows, "_one", key, order, "sum", "_n"), "_e", key, order, "sum", "_s")
    p = F.col("_s") / F.col("_n")
    out = out.withColumn("error_rate", p).withColumn("_sd", F.sqrt(p * (1 - p) / F.col("_n")))
    full = F.col("_n") >= min_rows
    best = F.when(full, F.struct((F.col("error_rate") + F.col("_sd")).alias("v"), F.col("error_rate").alias("p"),
                                 F.col("_sd").alias("s")))
    out = running(out.withColumn("_best", best), "_best", key, order, "min", "_low")
    now = F.col("error_rate") + F.col("_sd")
    level = F.when(full & (now > F.col("_low.p") + drift * F.col("_low.s")), "drift").when(
        full & (now > F.col("_low.p") + warning * F.col("_low.s")), "warning").otherwise("normal")
    return out.withColumn("level", level).drop("_one", "_e", "_n", "_s", "_sd", "_best", "_low")


def ddm_restart(df: DataFrame, error: str, key: Sequence[str] = ("source",), order: Sequence[str] = ORDER,
                warning: float = 2.0, drift: float = 3.0, min_rows: int = 30) -> DataFrame:
    """``ddm_flags`` as published: after a drift everything starts anew behind that row, so a
    key may drift more than once. Adds ``error_rate`` (since the start), ``level`` and
    ``segment`` (drifts so far).

    Rows are numbered over row-frame blocks, and the errors of each ``DDM_CHUNK`` of them are
    packed to a bit a row. A walk over a key's chunks carries what a restart forgets (rows, errors
    and the lowest rate so far) to the start of every chunk; chunks then give their rows' values
    at the same time, and these meet the rows by key and number. The number of jobs
    depends neither on rows nor on drifts; only the bits of a key pass one task, a batch at a time.

    The last join is a merge join by hint: Spark takes the rows' values for as small as the
    bits they come from, and would send them all through the driver as a broadcast."""
    key, order = list(key), list(order)
    ident = F.to_json(F.array(*[F.col(c).cast("string") for c in key]))
    rows = materialize(rows_index(df.filter(F.col(error).isNotNull()), key, order, name="_n").withColumn("_k", ident))
    chunk = F.floor((F.col("_n") - 1) / DDM_CHUNK).cast("long").alias("_c")
    chunks = rows.select("_k", chunk, F.col("_n").cast("long").alias("_n"), (F.col(error).cast("long") > 0).alias("_e")).groupBy("_k", "_c").applyInArrow(
        _packed, "_k string, _c long, m long, bits binary")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    started = chunks.repartition(n, "_k").sortWithinPartitions("_k", "_c").mapInPandas(
        _ddm_starts(warning, drift, min_rows), f"_k string, _c long, m long, bits binary, {_DDM_STATE}")
    marks = materialize(started).repartition(n, "_k", "_c").mapInPandas(
        _ddm_rows(warning, drift, min_rows), "_k string, _n long, error_rate double, level string, segment int")
    return rows.join(marks.hint("merge"), ["_k", "_n"]).select(*df.columns, "error_rate", "level", "segment")


DDM_CHUNK = 1 << 16  # rows
_DDM_STATE = "n long, e long, v double, p double, s double, segment int"
_LEVELS = np.array(["normal", "warning", "drift"], dtype=object)


def _packed(table: pa.Table) -> pa.Table:
    """The rows of a chunk to one, its errors a bit a row."""
    table = table.sort_by("_n")
    bits = np.packbits(table.column("_e").to_numpy(zero_copy_only=False)).tobytes()
    return pa.table([table.column("_k")[:1], table.column("_c")[:1], pa.array([len(table)], pa.int64()), pa.array([bits], pa.binary())],
                    names=["_k", "_c", "m", "bits"])


def ddm_run(errors: np.ndarray, state: tuple, warning: float, drift: float, min_rows: int) -> tuple[list, tuple]:
    """Pieces (rate, level 0 to 2, segment) of consecutive rows from ``state`` (rows and errors
    since the start, lowest v, p, s, segment), and the state behind them. A look at a row's
    followers doubles until one drifts."""
    n, e, v0, p0, s0, segment = state
    pieces, at, look = [], 0, 256
    while at < len(errors):
        x = errors[at:at + look]
        look *= 2
        rows = n + np.arange(1, len(x) + 1)
        bad = e + np.cumsum(x)
        p = bad / rows
        s = np.sqrt(np.maximum(p * (1 - p), 0.0) / rows)
        v = p + s
        full = rows >= min_rows
        lowest = np.minimum.accumulate(np.concatenate([[v0], np.where(full, v, np.inf)]))
        src = np.maximum.accumulate(np.where(full & (v < lowest[:-1]), np.arange(len(x)), -1))
        low_p, low_s = np.where(src >= 0, p[src], p0), np.where(src >= 0, s[src], s0)
        if (full & (v == lowest[1:]) & (p < low_p)).any():  # the same v again: the smaller rate counts
            low = (v0, p0, s0)
            for i in np.flatnonzero(full):
                low = min(low, (v[i], p[i], s[i]))
                low_p[i], low_s[i] = low[1:]
        level = np.where(full & (v > low_p + drift * low_s), 2, np.where(full & (v > low_p + warning * low_s), 1, 0))
        hit = np.flatnonzero(level == 2)
        end = int(hit[0]) + 1 if len(hit) else len(x)
        pieces.append((p[:end], level[:end], np.full(end, segment, "i4")))
        at += end
        if len(hit):
            n, e, v0, p0, s0, segment, look = 0, 0, np.inf, np.inf, np.inf, segment + 1, 256
        else:
            n, e, v0, p0, s0 = int(rows[-1]), int(bad[-1]), float(lowest[-1]), float(low_p[-1]), float(low_s[-1])
    return pieces, (n, e, v0, p0, s0, segment)


_DDM_START = (0, 0, np.inf, np.inf, np.inf, 0)


def _errors(bits: bytes, m: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, "u1"), count=m).astype("i8")


def _ddm_starts(warning: float, drift: float, min_rows: int):
    """Chunks by (key, chunk) with the state before each."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _DDM_START
        for pdf in batches:
            out = []
            for k, c, m, bits in pdf.itertuples(index=False, name=None):
                if k != at:
                    at, state = k, _DDM_START
                out.append((k, c, m, bits, *state))
                state = ddm_run(_errors(bits, m), state, warning, drift, min_rows)[1]
            yield pd.DataFrame(out, columns=["_k", "_c", "m", "bits", "n", "e", "v", "p", "s", "segment"])
    return walk


def _ddm_rows(warning: float, drift: float, min_rows: int):
    """Chunks with the state before them to their rows' values."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, c, m, bits, *state in pdf.itertuples(index=False, name=None):
                pieces, _ = ddm_run(_errors(bits, m), tuple(state), warning, drift, min_rows)
                rate, level, segment = (np.concatenate(x) for x in zip(*pieces, strict=True))
                yield pd.DataFrame({"_k": k, "_n": c * DDM_CHUNK + np.arange(1, m + 1), "error_rate": rate, "level": _LEVELS[level], "segment": segment})
    return run


def agreement(a: DataFrame, b: DataFrame, tolerance_s: int, key: str = "source") -> DataFrame:
    """Per key: patterns of ``a``, patterns of ``b``, how many of ``a`` have one of ``b``
    within ``tolerance_s`` seconds, and their share. Times are joined by buckets of the
    tolerance's width, so no pair of distant patterns is formed."""
    def bucket(df: DataFrame, shifts: Sequence[int]) -> DataFrame:
        at = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(max(tolerance_s, 1) * 1_000_000)).cast("long")
        return df.select(F.col(key).alias("_k"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_t"),
                         F.explode(F.array(*[at + F.lit(s) for s in shifts])).alias("_b"))

    x, y = bucket(a, [0]).distinct(), bucket(b, [-1, 0, 1]).distinct()
    y = y.select(F.col("_k").alias("_yk"), F.col("_t").alias("_yt"), F.col("_b").alias("_yb"))
    met = x.join(y, x["_k"].eqNullSafe(y["_yk"]) & (x["_b"] == y["_yb"]) & (
        F.abs(x["_t"] - y["_yt"]) <= F.lit(tolerance_s * 1_000_000)), "left_semi").select("_k", "_t")
    count = lambda df, n: df.groupBy("_k").agg(F.count(F.lit(1)).alias(n))
    parts = [count(x.select("_k", "_t"), "a"), count(b.select(F.col(key).alias("_k"), "timestamp").distinct(), "b"),
             count(met, "matched")]
    rows = parts[0].selectExpr("_k", "a", "0L AS b", "0L AS matched").unionByName(
        parts[1].selectExpr("_k", "0L AS a", "b", "0L AS matched")).unionByName(
        parts[2].selectExpr("_k", "0L AS a", "0L AS b", "matched"))
    out = rows.groupBy("_k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("matched").alias("matched"))
    return out.select(F.col("_k").alias(key), "a", "b", "matched", F.try_divide("matched", "a").alias("agreement"))


def factor_screen(df: DataFrame, factors: Sequence[str], forward: str, ts: str = "ts") -> DataFrame:
    """Per factor: ``ic`` (mean over time points of the correlation between the factor's
    and the forward value's ranks), ``ic_ir`` (mean / sample deviation), ``missing`` (share
    of null values) and ``points`` (time points with an IC). Ranks are per time point,
    which is bounded by the names at that time."""
    def rank(c: str, present: Column) -> Column:
        # rows that lack either value are ranked apart from the others
        return F.rank().over(Window.partitionBy(ts, present).orderBy(c)).cast("double")

    out = None
    for f in factors:
        has = F.col(f).isNotNull() & F.col(forward).isNotNull()
        ranked = df.select(ts, has.alias("_has"), F.col(f).isNull().cast("double").alias("_null"),
                           rank(f, has).alias("_a"), rank(forward, has).alias("_b"))
        per = ranked.groupBy(ts).agg(
            F.corr(F.when(F.col("_has"), F.col("_a")), F.when(F.col("_has"), F.col("_b"))).alias("_ic"),
            F.sum("_null").alias("_m"), F.count(F.lit(1)).alias("_n"))
        per = per.withColumn("_ic", F.when(~F.isnan("_ic"), F.col("_ic")))
        one = per.agg(F.avg("_ic").alias("ic"), F.try_divide(F.avg("_ic"), F.stddev_samp("_ic")).alias("ic_ir"),
                      F.try_divide(F.sum("_m"), F.sum("_n")).alias("missing"), F.count("_ic").alias("points"))
        one = one.select(F.lit(f).alias("factor"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def factor_correlations(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``a, b, corr`` for every pair of factors (a before b), over the rows that have both:
    all pairs in one aggregate, one scan whatever the number of factors."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def factor_select(df: DataFrame, factors: Sequence[str], forward: str, most: float = 0.7, ts: str = "ts") -> DataFrame:
    """``factor_screen`` with ``kept`` and ``rival``: factors in the order of the IC's size (no IC
    last, ties by name) are kept unless their correlation with one kept before exceeds
    ``most`` in size; the first such is the rival. The driver sees a row a factor and pair."""
    screen = factor_screen(df, factors, forward, ts).collect()
    size = {frozenset((r.a, r.b)): abs(r["corr"]) for r in factor_correlations(df, factors).collect() if r["corr"] is not None}
    order = sorted(screen, key=lambda r: (r.ic is None, -abs(r.ic or 0.0), r.factor))
    kept, rival = [], {}
    for r in order:
        rival[r.factor] = next((k for k in kept if size.get(frozenset((k, r.factor)), 0.0) > most), None)
        if rival[r.factor] is None:
            kept.append(r.factor)
    rows = [(r.factor, r.ic, r.ic_ir, r.missing, r.points, rival[r.factor] is None, rival[r.factor]) for r in order]
    return df.sparkSession.createDataFrame(rows, "factor string, ic double, ic_ir double, missing double, points long, kept boolean, rival string")


def bootstrap_return(df: DataFrame, price: str, key: Sequence[str], order: Sequence[str], block: int = 20, draws: int = 200,
                     level: float = 0.95) -> DataFrame:
    """Moving-block bootstrap of a total return: per key ``n`` (returns), ``total_return``,
    ``low`` and ``high``.

    Log returns from row to row are summed over every run of ``block`` rows (a row frame);
    a replicate adds up floor(n / block) runs whose starts come from a hash of key, replicate
    and number, scaled to n returns. Runs meet their draws by an equi-join on key and start, so
    nothing is copied per draw but the drawn runs. Keys with fewer returns than a block have
    no interval."""
    key, order = list(key), list(order)
    logs = over_rows(df, key, order, 1, lambda fr: [F.log(F.try_divide(F.col(price), F.lag(price, 1).over(fr.w))).alias("_r")])
    logs = materialize(logs.filter(F.col("_r").isNotNull()).select(*key, *order, "_r"))
    runs = over_rows(logs, key, order, block - 1, lambda fr: [F.sum("_r").over(fr.rows(block)).alias("_b"), (fr.rn - block).alias("_at")])
    total = logs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("_sum"))
    many = total.filter(F.col("n") >= block).withColumn("_m", F.floor(F.col("n") / block).cast("int"))
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.col("_d").cast("string"), F.col("_i").cast("string"))
    start = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") % (F.col("n") - block + 1)
    drawn = many.select(*key, "n", "_m", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"))
    drawn = drawn.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_m")))).withColumn("_at", start)
    sums = null_safe_join(drawn, runs.select(*key, "_at", "_b"), [*key, "_at"]).groupBy(*key, "_d").agg(
        (F.exp(F.sum("_b") * F.max("n") / (F.max("_m") * block)) - 1).alias("_t"))
    tail = (1 - level) / 2
    interval = sums.groupBy(*key).agg(F.percentile("_t", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    out = null_safe_join(total, interval, key, how="left")
    return out.select(*key, "n", (F.exp("_sum") - 1).alias("total_return"), F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def bootstrap_mean(df: DataFrame, col: str, ident: str, key: Sequence[str], draws: int = 200, level: float = 0.95
                   ) -> DataFrame:
    """Poisson bootstrap of a mean: in each of ``draws`` replicates a row counts as often
    as a Poisson(1) number from a hash of its ``ident`` and the replicate says. Returns
    per key ``mean``, ``low`` and ``high``. A row adds to ``draws`` partial sums, which are
    aggregated before the shuffle; quantiles are over the ``draws`` means of a key."""
    hexes = F.substring(F.md5(F.concat_ws("|", F.col(ident).cast("string"), F.col("_d").cast("string"))), 1, 13)
    u = F.conv(hexes, 16, 10).cast("long") / F.lit(float(1 << 52))
    weight = sum((u >= F.lit(c)).cast("int") for c in POISSON1_CDF)
    rows = df.filter(F.col(col).isNotNull()).select(*key, ident, col, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"))
    means = rows.withColumn("_w", weight).groupBy(*key, "_d").agg(
        F.try_divide(F.sum(F.col(col) * F.col("_w")), F.sum("_w")).alias("_m"))
    tail = (1 - level) / 2
    q = F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail)))
    return means.groupBy(*key).agg(F.avg("_m").alias("mean"), q.alias("_q")).select(
        *key, "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


# Cumulative Poisson(1) probabilities of 0, 1, ... to the last below 1 - 1e-9.
POISSON1_CDF = []
_term, _sum = 2.718281828459045 ** -1, 0.0
for _k in range(13):
    _sum += _term
    POISSON1_CDF.append(_sum)
    _term /= _k + 1


def retain(df: DataFrame, days: int, now, ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``days`` days before ``now`` (a day boundary, so that a table
    partitioned by ``event_date`` prunes whole days)."""
    first = F.date_sub(F.to_date(F.lit(now)), days - 1)
    col = F.col("event_date") if "event_date" in df.columns else F.to_date(ts)
    return df.filter(col >= first)


def replay_window(df: DataFrame, start, end, source: str, order: Sequence[str] = ORDER, epoch: int | None = None
                  ) -> DataFrame:
    """Replay events of one source with start <= timestamp < end."""
    t = F.col("timestamp")
    rows = df.filter((F.col("source") == source) & (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))
    return replay(rows, f"{source}_replay", order, epoch)


def obv(df: DataFrame, close: str = "close", volume: str = "volume", key: Sequence[str] = ("symbol",),
        order: Sequence[str] = ORDER) -> DataFrame:
    """On-balance volume: the running sum of the volume with the sign of the change of
    the close (0 on a key's first row)."""
    def build(fr: Frame):
        return [F.coalesce(F.signum(F.col(close) - F.lag(close, 1).over(fr.w)) * F.col(volume), F.lit(0.0)).alias("_v")]

    return running(over_rows(df, key, order, 1, build), "_v", key, order, "sum", "obv").drop("_v")
