"""Documented tier-2 time-series operators: lags and left-closed averages,
rolling statistics and indicators, multi-frequency bars, sliding / session
windows, stream fusion, pattern context, running totals and return statistics.

Row frames go through the hot-key planner (``over_rows``); per-key statistics
are ``groupBy`` aggregates (partial aggregation before the shuffle).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators.features import ema_weights
from ..plans.rolling import Frame, has_shuffle, materialize, null_safe_join, over_rows, running_rows

ORDER = ("timestamp", "event_id")
# Time buckets that the interval of a range join is cut into.
JOIN_PARTS = 4
# Pairs meant for a task of a range join and at most for a group of it, right rows at most in a
# group (Spark holds them in memory), and tasks at most.
PAIRS = 1 << 24
GROUP_ROWS = 1 << 18
MAX_TASKS = 1 << 15


def lagged_features(df: DataFrame, col: str, lags: Sequence[int] = (1,), windows: Sequence[int] = (5,),
                    key: Sequence[str] = ("symbol",), order: Sequence[str] = ORDER, split: bool = True,
                    emas: Sequence[int] = (), rsis: Sequence[int] = ()) -> DataFrame:
    """``{col}_lag{k}`` and left-closed ``{col}_ma{w}`` / ``{col}_std{w}`` / ``{col}_ema{p}`` /
    ``{col}_rsi{p}``: over the previous rows, not the current one (no look-ahead); null
    until enough exist (w, p and p + 1)."""
    look = max(list(lags) + list(windows) + list(emas) + [p + 1 for p in rsis] + [1])

    def build(fr: Frame):
        cols = [F.lag(col, k).over(fr.w).alias(f"{col}_lag{k}") for k in lags]
        for w in windows:
            frame = fr.w.rowsBetween(-w, -1)
            cols.append(F.when(fr.rn > w, F.avg(col).over(frame)).alias(f"{col}_ma{w}"))
            cols.append(F.when(fr.rn > w, F.stddev_pop(col).over(frame)).alias(f"{col}_std{w}"))
        for p in emas:
            terms = [F.lit(wt) * F.lag(col, j + 1).over(fr.w) for j, wt in enumerate(ema_weights(p))]
            cols.append(F.when(fr.rn > p, sum(terms[1:], terms[0])).alias(f"{col}_ema{p}"))
        if not rsis:
            return cols
        first = [(F.col(col) - F.lag(col, 1).over(fr.w)).alias("_d")]
        for p in rsis:
            frame = fr.w.rowsBetween(-p, -1)
            gain = F.sum(F.greatest(F.col("_d"), F.lit(0.0))).over(frame) / p
            loss = F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame) / p
            cols.append(F.when(fr.rn > p + 1, F.when(loss == 0, F.lit(100.0)).otherwise(
                F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss))).alias(f"{col}_rsi{p}"))
        return [first, cols]

    return over_rows(df, key, order, look, build, split=split).drop("_d")


def rolling_stats(df: DataFrame, col: str, window: int = 20, key: Sequence[str] = ("symbol",),
                  order: Sequence[str] = ORDER, split: bool = True, quantiles: Sequence[float] = ()) -> DataFrame:
    """Rolling mean / std (population) / min / max / median / rank / pct_rank of
    the current value inside the last ``window`` rows (full windows only), and
    ``{col}_q<percent>`` per entry of ``quantiles``."""
    def build(fr: Frame):
        w = fr.rows(window)
        full = fr.rn >= window
        cur = F.col(col)
        below = F.sum(F.when(F.col(col) < cur, 1).otherwise(0)).over(w)
        return [[F.when(full, F.avg(col).over(w)).alias(f"{col}_mean{window}"),
                 F.when(full, F.stddev_pop(col).over(w)).alias(f"{col}_std{window}"),
                 F.when(full, F.min(col).over(w)).alias(f"{col}_min{window}"),
                 F.when(full, F.max(col).over(w)).alias(f"{col}_max{window}"),
                 F.when(full, F.percentile(F.col(col), F.lit(0.5)).over(w)).alias(f"{col}_median{window}"),
                 *[F.when(full, F.percentile(F.col(col), F.lit(q)).over(w)).alias(f"{col}_q{round(q * 100)}")
                   for q in quantiles],
                 F.when(full, F.collect_list(col).over(w)).alias("_win")]] + [[
            F.when(full, F.size(F.filter("_win", lambda v: v < cur)) + 1).alias(f"{col}_rank{window}"),
            F.when(full, F.size(F.filter("_win", lambda v: v < cur)) / F.lit(float(window - 1)))
            .alias(f"{col}_pctrank{window}")]]

    return over_rows(df, key, order, window - 1, build, split=split).drop("_win")


def indicators(bars: DataFrame, key: Sequence[str] = ("source", "type"), order: Sequence[str] = ORDER,
               bb: int = 20, k: float = 2.0, atr: int = 14, fast: int = 12, slow: int = 26,
               split: bool = True) -> DataFrame:
    """Bollinger bands (SMA +- k * population std), ATR (mean true range), MACD
    (EMA_fast - EMA_slow, finite EMAs seeded at the window start) on flat
    open/high/low/close columns."""
    look = max(bb, atr + 1, slow)

    def build(fr: Frame):
        prev = F.lag("close", 1).over(fr.w)
        stage1 = [prev.alias("_pc")]
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")),
                        F.abs(F.col("low") - F.col("_pc")))
        sma = F.avg("close").over(fr.rows(bb))
        sd = F.stddev_pop("close").over(fr.rows(bb))

        def ema(p):
            terms = [F.lit(wt) * (F.col("close") if j == 0 else F.lag("close", j).over(fr.w))
                     for j, wt in enumerate(ema_weights(p))]
            return sum(terms[1:], terms[0])

        stage2 = [F.when(fr.rn >= bb, sma + k * sd).alias("bb_upper"), F.when(fr.rn >= bb, sma).alias("bb_mid"),
                  F.when(fr.rn >= bb, sma - k * sd).alias("bb_lower"),
                  F.when(fr.rn >= atr + 1, F.avg(tr).over(fr.rows(atr))).alias(f"atr_{atr}"),
                  F.when(fr.rn >= slow, ema(fast) - ema(slow)).alias("macd")]
        return [stage1, stage2]

    return over_rows(bars, key, order, look, build, split=split).drop("_pc")


def rollup_bars(bars: DataFrame, window: str, key: Sequence[str] = ("source", "type")) -> DataFrame:
    """Re-aggregate finer bars (flat open/high/low/close/volume/count, window_start)
    into coarser ones: first open, max high, min low, last close, sums."""
    from ..functions.timefmt import parse_duration

    secs = parse_duration(window)
    o = F.struct("window_start", "event_id")
    g = bars.groupBy(*key, F.window("window_start", f"{secs} seconds").alias("_w")).agg(
        F.min_by("open", o).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", o).alias("close"), F.sum("volume").alias("volume"), F.sum("count").alias("count"),
        F.max_by("event_id", o).alias("event_id"))
    return g.select(*key, F.col("_w.end").alias("timestamp"), F.col("_w.start").alias("window_start"),
                    "open", "high", "low", "close", "volume", "count", "event_id")


def bar_chain(bars: DataFrame, windows: Sequence[str], key: Sequence[str] = ("source", "type")) -> DataFrame:
    """Bars of several frequencies, each from the one before it: ``bars`` are those of the first
    window, and every window must be a multiple of the one before. One long table with the
    window's name in ``frequency``; a level is written once and read by the next."""
    from ..functions.timefmt import parse_duration

    seconds = [parse_duration(w) for w in windows]
    for (a, b), name in zip(zip(seconds, seconds[1:]), windows[1:]):  # noqa: B905
        if b % a or b <= a:
            raise ValueError(f"{name} is not a multiple of the window before it")
    level = materialize(bars)
    out = level.withColumn("frequency", F.lit(windows[0]))
    for name in windows[1:]:
        level = materialize(rollup_bars(level, name, key))
        out = out.select("frequency", *level.columns).unionByName(level.withColumn("frequency", F.lit(name)))
    return out


def sliding_counts(df: DataFrame, value: str, size: str, slide: str, key: Sequence[str] = ("type",)) -> DataFrame:
    """Sliding event-time windows: count and mean of ``value`` per key and window."""
    w = F.window("timestamp", size, slide)
    return df.groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        *key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean")


def sessions(df: DataFrame, gap: str, key: Sequence[str] = ("user_id",), order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Session windows: a session ends ``gap`` (an interval such as ``30 minutes``) after its
    last event, and an event at that very time still belongs to it, as in Spark's session
    windows. Rows without a time belong to no session, null keys are a key.

    A stream uses Spark's session windows. A table is cut into row-frame blocks: an event that
    lies more than ``gap`` behind the one before it opens a session, running sums over the blocks
    number the sessions, and sessions are pre-aggregated groups, so neither a hot key nor one
    endless session is a task of its own."""
    if df.isStreaming:
        w = F.session_window("timestamp", gap)
        return df.groupBy(*key, w.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
            *key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    key, order, long_gap = list(key), [c for c in order if c in df.columns], F.expr(f"INTERVAL '{gap}'")
    rows = df.filter(F.col("timestamp").isNotNull()).select(*key, *order)

    def opens(fr: Frame):
        before = F.lag("timestamp", 1).over(fr.w)
        return [F.when(before.isNull() | (F.col("timestamp") > before + long_gap), 1).otherwise(0).alias("_opens")]

    numbered = running_rows(rows, key, order, lambda w: [(F.sum("_opens").over(w) + F.coalesce("_before", F.lit(0))).alias("_session")],
                            totals=[F.sum("_opens").alias("_n")], merge=lambda w: [F.sum("_n").over(w).alias("_before")],
                            lookback=1, first=opens)
    return numbered.groupBy(*key, "_session").agg(
        F.min("timestamp").alias("session_start"), (F.max("timestamp") + long_gap).alias("session_end"),
        F.count(F.lit(1)).alias("n")).select(*key, "session_start", "session_end", "n")


def interval_join(left: DataFrame, right: DataFrame, before: int, after: int, on: Sequence[str] = ("source",),
                  lt: str = "timestamp", rt: str = "timestamp") -> DataFrame:
    """Rows of ``right`` within [left.t - before, left.t + after] seconds, same ``on``, with
    ``offset_sec``: whole microseconds over 10^6.

    A range join as an equi-join on coarse time buckets (``interval_pairs``), then the exact
    range is a filter. No cross join; a hot bucket is split.
    """
    pairs = interval_pairs(left, right, before, after, on, lt, rt)
    low, high = F.lit(-before * 1_000_000), F.lit(after * 1_000_000)
    return pairs.filter((F.col("_us") >= low) & (F.col("_us") <= high)).withColumn("offset_sec", F.col("_us") / 1e6).drop("_us")


def interval_pairs(left: DataFrame, right: DataFrame, before: int, after: int, on: Sequence[str], lt: str, rt: str) -> DataFrame:
    """The pairs that meet in a bucket, with their distance ``_us``. Each left row is copied
    to the buckets its interval touches; a bucket is a ``JOIN_PARTS``-th of the interval, so
    about one pair in ``JOIN_PARTS`` + 1 is out of range.

    Rows of both sides are counted per bucket first. The pairs are as many as the product, so
    the join gets a task for about ``PAIRS`` of them, where Spark would go by its input; and right
    rows of a bucket with more than ``PAIRS`` or ``GROUP_ROWS`` are dealt by their hash to groups
    within both bounds, each of which gets all left rows of the bucket."""
    known = lambda df, at: df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*on, at]]))
    left, right = (materialize(df) if has_shuffle(df) else df for df in (known(left, lt), known(right, rt)))
    width = max(-(-(before + after) * 1_000_000 // JOIN_PARTS), 1)
    at = lambda us: us - F.pmod(us, F.lit(width))
    lus = F.unix_micros(F.col(lt))
    touched = F.sequence(at(lus - F.lit(before * 1_000_000)), at(lus + F.lit(after * 1_000_000)), F.lit(width))
    lb = left.select("*", F.explode(touched).alias("_b"))
    named = {c: f"r_{c}" if c in left.columns else c for c in right.columns}
    rb = right.select(*[F.col(c).alias(n) for c, n in named.items()]).withColumn("_b", at(F.unix_micros(F.col(named[rt]))))
    keys = [*[named[c] for c in on], "_b"]
    lc = lb.groupBy(*[F.col(c).alias(named[c]) for c in on], "_b").agg(F.count(F.lit(1)).alias("_l"))
    counts = lc.join(rb.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys).withColumn("_p", F.col("_l") * F.col("_r"))
    groups = F.ceil(F.greatest(F.col("_p") / F.lit(PAIRS), F.col("_r") / F.lit(GROUP_ROWS))).cast("int")
    counts = materialize(counts.withColumn("_groups", groups))  # a row a bucket
    total, hot = counts.agg(F.sum("_p"), F.count_if(F.col("_groups") > 1)).first()
    lb, rb = lb.withColumn("_g", F.lit(0)), rb.withColumn("_g", F.lit(0))
    if hot:  # a row for PAIRS pairs or GROUP_ROWS rows at least
        split = counts.filter("_groups > 1").select(*[F.col(named[c]).alias(c) for c in on], "_b", "_groups")
        n = F.coalesce("_groups", F.lit(1))
        lb = null_safe_join(lb, split, [*on, "_b"], broadcast=True, how="left").withColumn("_g", F.explode(F.sequence(F.lit(0), n - 1)))
        mine = F.pmod(F.xxhash64(*[named[c] for c, t in right.dtypes if "map<" not in t and "variant" not in t]), n).cast("int")
        rb = null_safe_join(rb, split.withColumnsRenamed({c: named[c] for c in on}), keys, broadcast=True, how="left").withColumn("_g", mine)
        lb, rb = lb.drop("_groups"), rb.drop("_groups")
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(-(-(total or 0) // PAIRS), MAX_TASKS))
    # one text as key: of a list Spark takes constants (a single source) out, and deals the rows anew
    kinds = {c: left.schema[c].dataType for c in on}
    text = lambda names: F.to_json(F.array(*[F.col(c).cast("string") for c in ("_b", "_g")], *[F.col(n).cast(kinds[c]).cast("string") for c, n in names.items()]))
    lb = lb.withColumn("_k", text({c: c for c in on})).drop("_b", "_g").repartition(n, "_k")
    rb = rb.withColumn("_m", text({c: named[c] for c in on})).drop("_b", "_g").repartition(n, "_m").hint("merge")
    out = lb.join(rb, lb["_k"] == rb["_m"]).withColumn("_us", F.unix_micros(F.col(named[rt])) - F.unix_micros(F.col(lt)))
    return out.drop("_k", "_m")


def pattern_context(patterns: DataFrame, events: DataFrame, minutes: int = 5) -> DataFrame:
    """Clean events within +-``minutes`` of each pattern, same source."""
    ev = events.select("event_id", "source", "timestamp", "type")
    pt = patterns.select("pattern_id", "source", "timestamp", F.col("type").alias("pattern_type"))
    return interval_join(pt, ev, minutes * 60, minutes * 60)


def fuse(frames: Mapping[str, DataFrame], window: str, value: str, keys: Sequence[str] = (),
         watermark: str | None = None) -> DataFrame:
    """Stream fusion: per source, mean ``value`` per aligned event-time window,
    then inner-joined on (window start, keys). With ``watermark`` the inputs may
    be streams (stream-stream join on the window)."""
    parts = []
    for name, df in frames.items():
        d = df.withWatermark("timestamp", watermark) if watermark else df
        g = d.groupBy(*keys, F.window("timestamp", window).alias("w")).agg(F.avg(value).alias(f"{name}__{value}"),
                                                                             F.count(F.lit(1)).alias(f"{name}__n"))
        parts.append(g.select(*keys, F.col("w.start").alias("window_start"), f"{name}__{value}", f"{name}__n"))
    return reduce(lambda a, b: a.join(b, list(keys) + ["window_start"]), parts)


def align_on_ts(frames: Mapping[str, DataFrame], on: Sequence[str] = ("ts",), how: str = "inner") -> DataFrame:
    """n-way join on the time (and symbol) columns; other columns are prefixed
    ``name__col``; outer = union of time points."""
    out = None
    for name, df in frames.items():
        d = df.select(*on, *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c not in on])
        out = d if out is None else out.join(d, list(on), "full_outer" if how == "outer" else "inner")
    return out


def running(df: DataFrame, col: str, key: Sequence[str], order: Sequence[str], how: str = "sum",
            name: str | None = None) -> DataFrame:
    """Running sum / max / min of ``col`` per key in order, without one task per key:
    the totals of a key's earlier blocks (a row a block) are added to the running value
    inside each block."""
    name = name or f"running_{how}"
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]

    def value(w):
        inner = agg(col).over(w)
        if how == "sum":
            return [F.coalesce(F.col("_p") + inner, inner, F.col("_p")).alias(name)]
        return [(F.greatest if how == "max" else F.least)(F.col("_p"), inner).alias(name)]

    return running_rows(df, key, order, value, [agg(col).alias("_c")], lambda w: [agg("_c").over(w).alias("_p")])


def return_stats(prices: DataFrame, price: str = "close", key: Sequence[str] = ("symbol",),
                 order: Sequence[str] = ("ts",), periods: int = 252) -> DataFrame:
    """Per key: total and annualised return, volatility, Sharpe (rf = 0), max
    drawdown (via a running max), historical VaR / ES at 95 %."""
    key = list(key)
    lagged = over_rows(prices, key, order, 1, lambda fr: [F.lag(price, 1).over(fr.w).alias("_prev"),
                                                            fr.rn.alias("_n")])
    r = lagged.withColumn("ret", F.try_divide(F.col(price), F.col("_prev")) - 1)
    dd = running(r, price, key, order, "max", "_peak").withColumn("_dd", F.try_divide(F.col(price), F.col("_peak")) - 1)
    stats = dd.groupBy(*key).agg(
        F.count("ret").alias("n"), F.min_by(price, "_n").alias("_first"), F.max_by(price, "_n").alias("_last"),
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.min("_dd").alias("max_drawdown"))
    q05 = exact_quantiles(dd, key, "ret", [0.05], "_q05")
    stats = null_safe_join(stats, q05.withColumn("_q05", F.col("_q05")[0]), key)
    es = null_safe_join(r, stats.select(*key, "_q05"), key).filter(F.col("ret") <= F.col("_q05")).groupBy(*key).agg(
        F.avg("ret").alias("_es"))
    es = es.select(*[F.col(k).alias(f"_e_{k}") for k in key], "_es")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in key])
    out = stats.join(es, match, "left")
    total = F.try_divide(F.col("_last"), F.col("_first")) - 1
    return out.select(
        *key, "n", total.alias("total_return"),
        F.when(F.col("n") > 0, F.pow(1 + total, F.lit(float(periods)) / F.col("n")) - 1).alias("annual_return"),
        "vol", F.when(F.col("vol") > 0, F.col("mean") / F.col("vol") * math.sqrt(periods)).alias("sharpe"),
        "max_drawdown", (-F.col("_q05")).alias("var_95"), (-F.col("_es")).alias("es_95"))


def trend(df: DataFrame, col: str, window: int = 20, key: Sequence[str] = ("symbol",),
          order: Sequence[str] = ORDER, split: bool = True) -> DataFrame:
    """Trend strength |slope| / std(residual) of ``col`` on the row index over the
    last ``window`` rows, range box (max - min) and a breakout label (value above
    the previous window's max)."""
    def build(fr: Frame):
        w = fr.rows(window)
        x = fr.rn.cast("double")
        prev = fr.w.rowsBetween(-window, -1)
        s1 = [x.alias("_x")]
        slope = F.regr_slope(F.col(col), F.col("_x")).over(w)
        r2 = F.regr_r2(F.col(col), F.col("_x")).over(w)
        sy = F.stddev_pop(col).over(w)
        resid = sy * F.sqrt(F.greatest(F.lit(0.0), 1 - r2))
        s2 = [F.when(fr.rn >= window, F.try_divide(F.abs(slope), resid)).alias("trend_strength"),
              F.when(fr.rn >= window, F.max(col).over(w) - F.min(col).over(w)).alias("range_box"),
              F.when(fr.rn > window, F.col(col) > F.max(col).over(prev)).alias("breakout")]
        return [s1, s2]

    return over_rows(df, key, order, window, build, split=split).drop("_x")


def microstructure(trades: DataFrame, window: str = "1h", key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key and window: VWAP, order imbalance (buy - sell) / (buy + sell) volume,
    Parkinson volatility sqrt(ln(h/l)^2 / (4 ln 2)), Garman-Klass volatility
    sqrt(ln(h/l)^2 / 2 - (2 ln 2 - 1) ln(c/o)^2) and Amihud |ret| / dollar volume."""
    w = F.window("timestamp", window)
    pq = F.col("price") * F.col("quantity")
    g = trades.groupBy(*key, w.alias("w")).agg(
        F.try_divide(F.sum(pq), F.sum("quantity")).alias("vwap"),
        F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))).alias("_imb"),
        F.sum("quantity").alias("_vol"), F.max("price").alias("_h"), F.min("price").alias("_l"),
        F.min_by("price", F.struct("timestamp", "price", "quantity")).alias("_o"),
        F.max_by("price", F.struct("timestamp", "price", "quantity")).alias("_c"),
        F.sum(pq).alias("dollar_volume"))
    return g.select(*key, F.col("w.start").alias("window_start"), "vwap",
                    F.try_divide(F.col("_imb"), F.col("_vol")).alias("imbalance"),
                    F.sqrt(F.pow(F.log(F.try_divide(F.col("_h"), F.col("_l"))), 2) / (4 * math.log(2))).alias("parkinson"),
                    F.sqrt(F.greatest(F.pow(F.log(F.try_divide(F.col("_h"), F.col("_l"))), 2) / 2 - (2 * math.log(2) - 1)
                           * F.pow(F.log(F.try_divide(F.col("_c"), F.col("_o"))), 2), F.lit(0.0))).alias("garman_klass"),
                    F.try_divide(F.abs(F.try_divide(F.col("_c"), F.col("_o")) - 1), F.col("dollar_volume")).alias("amihud"),
                    "dollar_volume")


def realised_volatility(df: DataFrame, price: str, window: str, key: Sequence[str] = ("symbol",),
                        order: Sequence[str] = ORDER) -> DataFrame:
    """Per key and time window: ``realised_vol``, the root of the sum of squared log
    returns from row to row (a window's first return starts in the window before)."""
    def build(fr: Frame):
        return [F.log(F.try_divide(F.col(price), F.lag(price, 1).over(fr.w))).alias("_r")]

    r = over_rows(df, key, order, 1, build)
    return r.groupBy(*key, F.window("timestamp", window).alias("w")).agg(
        F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("realised_vol"), F.count("_r").alias("n")).select(
        *key, F.col("w.start").alias("window_start"), "realised_vol", "n")
