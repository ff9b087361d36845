"""Catalog: documented tier-2 operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..extras.crosssection import cs_rank, cs_winsorize, cs_zscore, neutralize, topn_overlap
from ..extras.quality import (business_days, per_trading_day, feedback_by_pattern, feedback_stats, iqr_filter, keyword_topk, pattern_report, psi,
                              snapshot_id, zscore_filter, frequent_itemsets)
from ..extras.sequences import frequent_sequences, fuse_asof
from ..extras.timeseries import (align_on_ts, indicators, lagged_features, microstructure, pattern_context,
                                 realised_volatility, return_stats, bar_chain, rollup_bars, rolling_stats, sessions, sliding_counts, trend)
from ..detectors.drift import drift_flags
from ..extras.screening import (POISSON1_CDF, agreement, bootstrap_mean, bootstrap_return, ddm_flags, ddm_restart, factor_screen,
                                factor_select, obv, replay_window,
                                retain)
from ..operators.bars import aggregate, flatten_bars
from ..operators.features import ema_weights
from ..operators.validate import dead_letter
from ..sources.messages import parse_trades
from ..sources.replay import replay
from ..sources.tables import events_envelope, events_raw_json, events_shifted, table
from .api import FB_IDS, FEEDBACK, PATTERNS, feedback_table, patterns_table
from .common import EV, EVS, finish, r6
from .detect import DRIFT_DELTA, DRIFT_FRAME, DRIFT_GRACE, drift_body
from .io import trade_messages


def flat_events(spark, sf):
    ev = events_envelope(spark, sf)
    return ev.select("event_id", "source", "type", "timestamp", F.col("payload.price").alias("price"),
                     F.col("payload.quantity").alias("quantity"), F.col("payload.user_id").alias("user_id"))


def q_lagged_features(spark, sf):
    out = lagged_features(flat_events(spark, sf), "price", lags=(1, 3), windows=(5,), key=("user_id",), emas=(4,), rsis=(5,))
    return finish(out.select("event_id", "price_lag1", "price_lag3", "price_ma5", "price_std5", "price_ema4", "price_rsi5"))


def q_rolling_stats(spark, sf):
    out = rolling_stats(flat_events(spark, sf), "price", 20, key=("type",), quantiles=(0.9,))
    return finish(out.select("event_id", "price_mean20", "price_std20", "price_min20", "price_max20",
                             "price_median20", "price_q90", "price_rank20", "price_pctrank20"))


def _flat_bars(spark, sf, window="1h"):
    return flatten_bars(aggregate(events_envelope(spark, sf), window=window))


def q_indicators(spark, sf):
    out = indicators(_flat_bars(spark, sf))
    return finish(out.select("event_id", "type", "bb_upper", "bb_mid", "bb_lower", "atr_14", "macd"))


def q_multi_frequency_bars(spark, sf):
    return finish(rollup_bars(_flat_bars(spark, sf, "5m"), "1h"))


CHAIN = ("1m", "5m", "1h", "24h")


def q_bar_chain(spark, sf):
    """Bars of four frequencies, each from the one before."""
    return finish(bar_chain(_flat_bars(spark, sf, CHAIN[0]), CHAIN))


def q_sliding_window(spark, sf):
    return finish(sliding_counts(flat_events(spark, sf), "price", "1 hour", "15 minutes"))


def q_session_window(spark, sf):
    return finish(sessions(flat_events(spark, sf), "30 minutes"))


def q_session_source(spark, sf):
    """Sessions of the whole source, one hot key."""
    return finish(sessions(flat_events(spark, sf), "10 minutes", key=("source",)))


def q_pattern_context(spark, sf):
    pats = patterns_table(spark, sf)
    return _context(pats, flat_events(spark, sf))


def _context(pats, events):
    # offsets are whole microseconds over 10^6, which rounding to six places leaves as they are
    return pattern_context(pats, events, 5).select("pattern_id", F.col("event_id").alias("r_event_id"), "offset_sec")


def _daily(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts")).agg(
        F.sum("l_extendedprice").alias("revenue"))
    od = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(
        F.count(F.lit(1)).alias("orders"))
    return li, od


def q_align_on_ts(spark, sf):
    li, od = _daily(spark, sf)
    return finish(align_on_ts({"ship": li, "order": od}, ["ts"], how="outer"))


def supplier_day(spark, sf):
    li = table(spark, sf, "lineitem")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    g = li.groupBy(F.to_date("l_shipdate").alias("ts"), F.col("l_suppkey").alias("symbol")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("qty"))
    return g.join(su, g.symbol == su.s_suppkey).drop("s_suppkey")


def q_cs_rank(spark, sf):
    d = supplier_day(spark, sf)
    out = cs_rank(cs_rank(d, "revenue"), "qty", method="minmax")
    return finish(out.select("ts", "symbol", "revenue_rank", "qty_rank"))


def q_cs_zscore(spark, sf):
    return finish(cs_zscore(supplier_day(spark, sf), "revenue").select("ts", "symbol", "revenue_z"))


def q_winsorize(spark, sf):
    return finish(cs_winsorize(supplier_day(spark, sf), "revenue", 0.1, 0.9).select("ts", "symbol", "revenue_wins"))


def q_neutralize(spark, sf):
    return finish(neutralize(supplier_day(spark, sf), "revenue", "s_nationkey").select("ts", "symbol", "revenue_neu"))


def q_topn_overlap(spark, sf):
    d = supplier_day(spark, sf)
    return finish(topn_overlap(d, d, "revenue", "qty", 5))


def q_keywords_topk(spark, sf):
    return keyword_topk(table(spark, sf, "documents"), 20)


def _type_closes(spark, sf):
    b = flatten_bars(aggregate(events_envelope(spark, sf), window="24h"))
    return b.select(F.col("type").alias("symbol"), F.col("timestamp").alias("ts"), "close")


def q_return_stats(spark, sf):
    return finish(return_stats(_type_closes(spark, sf), "close", ("symbol",), ("ts",)))


def q_trend(spark, sf):
    out = trend(flat_events(spark, sf), "price", 20, key=("type",))
    return finish(out.select("event_id", "trend_strength", "range_box", "breakout"))


def q_microstructure(spark, sf):
    tr = parse_trades(trade_messages(spark, sf, faults=False))
    flat = tr.select("timestamp", "payload.*")
    return finish(microstructure(flat, "24 hours", ("symbol",)))


def q_outliers_zscore(spark, sf):
    return finish(zscore_filter(flat_events(spark, sf), "price", ["type"], 3.0).select("event_id", "type", "price"))


def q_outliers_iqr(spark, sf):
    return finish(iqr_filter(flat_events(spark, sf), "price", ["type"], 1.5).select("event_id", "type", "price"))


def q_psi(spark, sf):
    ev = flat_events(spark, sf)
    mid = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return finish(psi(ev.filter(F.col("timestamp") < mid), ev.filter(F.col("timestamp") >= mid), "price"))


def q_pattern_report(spark, sf):
    return finish(pattern_report(patterns_table(spark, sf)))


def q_feedback_stats(spark, sf):
    from ..plans.query import accept_feedback

    pats = patterns_table(spark, sf)
    acc, _ = accept_feedback(feedback_table(spark, sf), pats, id_cols=FB_IDS)
    return finish(feedback_stats(acc, pats))


def q_feedback_by_pattern(spark, sf):
    from ..plans.query import accept_feedback

    pats = patterns_table(spark, sf)
    acc, _ = accept_feedback(feedback_table(spark, sf), pats, id_cols=FB_IDS)
    return finish(feedback_by_pattern(acc, pats))


FUSED = ("click", "purchase")
SEQUENCE_USERS = 60
# Deviations for a drift in the restarted detector.
DDM_DRIFT = 2.5


def ddm_sql(key: str) -> str:
    """DDM with restart, row by row, as a recursion per key."""
    return f"""ddm_e AS (SELECT event_id, {key} AS k, "timestamp", row_number() OVER (PARTITION BY {key} ORDER BY "timestamp", event_id) AS i,
  (price > 100)::BIGINT AS error FROM ev WHERE price IS NOT NULL),
ddm_r AS (
  SELECT k, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS e, NULL::STRUCT(v DOUBLE, p DOUBLE, s DOUBLE) AS low, 'normal' AS level, -1 AS segment,
         true AS fresh FROM ddm_e WHERE i = 1
  UNION ALL
  SELECT k, i, n, e, low, level, segment, level = 'drift' AS fresh FROM (
    SELECT *, CASE WHEN n >= 30 AND v > low.p + {DDM_DRIFT} * low.s THEN 'drift' WHEN n >= 30 AND v > low.p + 2.0 * low.s THEN 'warning'
                   ELSE 'normal' END AS level FROM (
      SELECT k, i, n, e, segment, v, CASE WHEN n >= 30 AND (low IS NULL OR v < low.v) THEN {{'v': v, 'p': p, 's': v - p}} ELSE low END AS low FROM (
        SELECT *, p + sqrt(p * (1 - p) / n) AS v FROM (
          SELECT *, e / n::DOUBLE AS p FROM (
            SELECT x.k, x.i, CASE WHEN fresh THEN 1 ELSE n + 1 END AS n, CASE WHEN fresh THEN 0 ELSE e END + x.error AS e,
                   CASE WHEN fresh THEN NULL ELSE low END AS low, segment + fresh::INT AS segment
            FROM ddm_r AS r JOIN ddm_e AS x ON x.k = r.k AND x.i = r.i + 1))))))"""


def q_ddm_levels(spark, sf):
    """Error = a price above 100 in the shifted series, per event type."""
    ev = events_shifted(spark, sf).withColumn("error", (F.col("payload.price") > 100).cast("int"))
    out = ddm_flags(ev, "error", key=("type",))
    return finish(out.select("event_id", "type", "error_rate", "level"))


def q_ddm_restart(spark, sf):
    """The same errors, with a fresh start behind every drift."""
    ev = events_shifted(spark, sf).withColumn("error", (F.col("payload.price") > 100).cast("int"))
    out = ddm_restart(ev, "error", key=("type",), drift=DDM_DRIFT)
    return finish(out.select("event_id", "type", "error_rate", "level", "segment"))


def q_two_detectors(spark, sf):
    """Drift of one series by two detectors, adjacent frames and DDM with restart, within a day."""
    ev = events_shifted(spark, sf)
    a = drift_flags(ev, "price", DRIFT_FRAME, DRIFT_DELTA, DRIFT_GRACE).filter("drift")
    errors = ev.withColumn("error", (F.col("payload.price") > 100).cast("int"))
    b = ddm_restart(errors, "error", key=("source",), drift=DDM_DRIFT).filter("level = 'drift'")
    return finish(agreement(a, b, 86400))


def q_factor_select(spark, sf):
    """Four factors of a supplier's day, of which those like a better one go."""
    d = supplier_day(spark, sf)
    nxt = Window.partitionBy("symbol").orderBy("ts")
    d = d.withColumn("forward", F.lead("revenue").over(nxt)).withColumn("unit", F.col("revenue") / F.col("qty")).withColumn(
        "root", F.sqrt("qty"))
    return finish(factor_select(d, ["revenue", "qty", "unit", "root"], "forward").select("factor", "ic", "kept", "rival"))


def q_bootstrap_return(spark, sf):
    ev = flat_events(spark, sf).withColumn("price", F.col("price") + 100)
    return finish(bootstrap_return(ev, "price", ["type"], ["timestamp", "event_id"], block=50, draws=40))


def q_fusion_asof(spark, sf):
    """Last click and last purchase price of a user at each of its clicks and purchases."""
    ev = flat_events(spark, sf)
    out = fuse_asof({t: ev.filter(F.col("type") == t) for t in FUSED}, "price", ["user_id"], ["timestamp", "event_id"])
    return finish(out.select("event_id", "user_id", F.col("source_name").alias("type"), *FUSED))


def q_frequent_sequences(spark, sf):
    """Ordered patterns of event types that at least 60 users show."""
    out = frequent_sequences(flat_events(spark, sf), "type", ["user_id"], ["timestamp", "event_id"], SEQUENCE_USERS)
    return out.select(F.array_join("pattern", ">").alias("pattern"), "length", "support")


def q_detector_agreement(spark, sf):
    """Drift of the shifted price against drift of its quantity, within an hour."""
    ev = events_shifted(spark, sf)
    a, b = (drift_flags(ev, f, DRIFT_FRAME, DRIFT_DELTA, DRIFT_GRACE).filter("drift") for f in ("price", "quantity"))
    return finish(agreement(a, b, 3600))


def q_factor_screen(spark, sf):
    """Revenue and quantity of a supplier's day against its revenue of the next day it sells."""
    d = supplier_day(spark, sf)
    nxt = Window.partitionBy("symbol").orderBy("ts")
    d = d.withColumn("forward", F.lead("revenue").over(nxt)).withColumn("qty", F.when(F.col("qty") > 10, F.col("qty")))
    return finish(factor_screen(d, ["revenue", "qty"], "forward"))


def q_bootstrap_mean(spark, sf):
    return finish(bootstrap_mean(flat_events(spark, sf), "price", "event_id", ["type"], draws=50))


def q_retention(spark, sf):
    ev = retain(flat_events(spark, sf), 7, "2024-01-20 10:00:00")
    return finish(ev.select("event_id", "timestamp"))


def q_replay_window(spark, sf):
    ev = events_envelope(spark, sf).select("event_id", "source", "timestamp")
    out = replay_window(ev, "2024-01-05 00:00:00", "2024-01-07 00:00:00", "events", epoch=0)
    return out.select("event_id", "source", "type", F.get_json_object("payload", "$.event_id").alias("original"))


def q_obv(spark, sf):
    out = obv(_flat_bars(spark, sf), key=("source", "type"))
    return finish(out.select("event_id", "type", "obv"))


def q_realised_volatility(spark, sf):
    ev = flat_events(spark, sf).withColumn("level", F.col("price") + 100)
    return finish(realised_volatility(ev, "level", "24 hours", key=("type",)))


def q_align_common(spark, sf):
    """Only the days that both series have, the documented default."""
    li, od = _daily(spark, sf)
    return finish(align_on_ts({"ship": li, "order": od}))


def q_snapshot_id(spark, sf):
    return snapshot_id(table(spark, sf, "orders"))


HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-02-19"]


def q_trading_days(spark, sf):
    """Events per trading day of Shanghai wall time."""
    closed = spark.createDataFrame([(d,) for d in HOLIDAYS], "day string")
    return per_trading_day(flat_events(spark, sf), "timestamp", "Asia/Shanghai", closed)


def q_replay_paced(spark, sf):
    """Two passes over the orders at four rows a second."""
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    ev = replay(od, "orders_replay", ["o_orderdate", "o_orderkey"], epoch=1_700_000_000, rate=4.0, loops=2)
    return finish(ev.select("event_id", "timestamp", "original_index", F.col("pass").alias("pass_no")))


def q_business_days(spark, sf):
    return business_days(table(spark, sf, "orders"), "o_orderdate")


def q_frequent_itemsets(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    pt = table(spark, sf, "part").select("p_partkey", "p_type")
    baskets = li.join(pt, li.l_partkey == pt.p_partkey).groupBy("l_orderkey").agg(
        F.collect_set("p_type").alias("items"))
    items, _ = frequent_itemsets(baskets, "items", 0.01, 0.5)
    return finish(items.select(F.array_join(F.array_sort("items"), "|").alias("itemset"), "freq"))


def q_dead_letter(spark, sf):
    dl = dead_letter(events_raw_json(spark, sf), ["k", "price"])
    return dl.select("event_id", "reason")


QUERIES = {
    "lagged_features": q_lagged_features,
    "rolling_stats": q_rolling_stats,
    "indicators": q_indicators,
    "multi_frequency_bars": q_multi_frequency_bars,
    "sliding_window": q_sliding_window,
    "session_window": q_session_window,
    "session_source": q_session_source,
    "bar_chain": q_bar_chain,
    "trading_days": q_trading_days,
    "replay_paced": q_replay_paced,
    "pattern_context": q_pattern_context,
    "align_on_ts": q_align_on_ts,
    "cs_rank": q_cs_rank,
    "cs_zscore": q_cs_zscore,
    "winsorize": q_winsorize,
    "neutralize": q_neutralize,
    "topn_overlap": q_topn_overlap,
    "keywords_topk": q_keywords_topk,
    "return_stats": q_return_stats,
    "trend": q_trend,
    "microstructure": q_microstructure,
    "outliers_zscore": q_outliers_zscore,
    "outliers_iqr": q_outliers_iqr,
    "psi": q_psi,
    "pattern_report": q_pattern_report,
    "feedback_stats": q_feedback_stats,
    "snapshot_id": q_snapshot_id,
    "business_days": q_business_days,
    "frequent_itemsets": q_frequent_itemsets,
    "dead_letter": q_dead_letter,
    "feedback_by_pattern": q_feedback_by_pattern,
    "ddm_levels": q_ddm_levels,
    "detector_agreement": q_detector_agreement,
    "ddm_restart": q_ddm_restart,
    "fusion_asof": q_fusion_asof,
    "frequent_sequences": q_frequent_sequences,
    "two_detectors": q_two_detectors,
    "factor_select": q_factor_select,
    "bootstrap_return": q_bootstrap_return,
    "factor_screen": q_factor_screen,
    "bootstrap_mean": q_bootstrap_mean,
    "retention": q_retention,
    "replay_window": q_replay_window,
    "obv": q_obv,
    "align_common": q_align_common,
    "realised_volatility": q_realised_volatility,
}

_UW = 'PARTITION BY user_id ORDER BY "timestamp", event_id'
_TW = 'PARTITION BY type ORDER BY "timestamp", event_id'
_BW = 'PARTITION BY source, type ORDER BY "timestamp", event_id'


def _ema(p: int) -> str:
    return " + ".join(f"{w!r} * " + ("close" if j == 0 else f"lag(close, {j}) OVER ({_BW})")
                      for j, w in enumerate(ema_weights(p)))


_HB = EV + """,
hb AS (SELECT source, type || '_aggregated' AS type, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS "timestamp",
              first(event_id ORDER BY "timestamp" DESC, event_id DESC) AS event_id,
              max(price) AS high, min(price) AS low, first(price ORDER BY "timestamp" DESC, event_id DESC) AS close
       FROM ev GROUP BY 1, 2, 3),
hr AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY "timestamp", event_id) AS rn,
              lag(close) OVER (PARTITION BY source, type ORDER BY "timestamp", event_id) AS pc FROM hb)"""

_SD = """sd AS (SELECT CAST(l_shipdate AS DATE) AS ts, l_suppkey AS symbol, sum(l_extendedprice) AS revenue,
                   sum(l_quantity) AS qty, any_value(s_nationkey) AS s_nationkey
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

ORACLE = {
    "lagged_features": f"""WITH {EV}, r AS (SELECT *, row_number() OVER ({_UW}) AS rn, price - lag(price) OVER ({_UW}) AS d FROM ev),
gl AS (SELECT *, sum(greatest(d, 0)) OVER ({_UW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / 5 AS gain,
              sum(greatest(-d, 0)) OVER ({_UW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / 5 AS loss FROM r)
SELECT event_id, {r6(f'lag(price, 1) OVER ({_UW})')} AS price_lag1, {r6(f'lag(price, 3) OVER ({_UW})')} AS price_lag3,
       CASE WHEN rn > 5 THEN {r6(f'avg(price) OVER ({_UW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} END AS price_ma5,
       CASE WHEN rn > 5 THEN {r6(f'stddev_pop(price) OVER ({_UW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} END AS price_std5,
       CASE WHEN rn > 4 THEN {r6(" + ".join(f"{w!r} * lag(price, {j + 1}) OVER ({_UW})" for j, w in enumerate(ema_weights(4))))} END AS price_ema4,
       CASE WHEN rn > 6 THEN {r6('CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END')} END AS price_rsi5
FROM gl""",
    "rolling_stats": f"""WITH {EV}, r AS (SELECT *, row_number() OVER ({_TW}) AS rn,
       list(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS win FROM ev)
SELECT event_id,
  CASE WHEN rn >= 20 THEN {r6(f'avg(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS price_mean20,
  CASE WHEN rn >= 20 THEN {r6(f'stddev_pop(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS price_std20,
  CASE WHEN rn >= 20 THEN {r6(f'min(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS price_min20,
  CASE WHEN rn >= 20 THEN {r6(f'max(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS price_max20,
  CASE WHEN rn >= 20 THEN {r6(f'quantile_cont(price, 0.5) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS price_median20,
  CASE WHEN rn >= 20 THEN {r6(f'quantile_cont(price, 0.9) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS price_q90,
  CASE WHEN rn >= 20 THEN len(list_filter(win, lambda v: v < price)) + 1 END AS price_rank20,
  CASE WHEN rn >= 20 THEN {r6('len(list_filter(win, lambda v: v < price)) / 19.0')} END AS price_pctrank20
FROM r""",
    "indicators": f"""WITH {_HB},
tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS t FROM hr)
SELECT event_id, type,
  CASE WHEN rn >= 20 THEN {r6(f'avg(close) OVER ({_BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 2.0 * stddev_pop(close) OVER ({_BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS bb_upper,
  CASE WHEN rn >= 20 THEN {r6(f'avg(close) OVER ({_BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS bb_mid,
  CASE WHEN rn >= 20 THEN {r6(f'avg(close) OVER ({_BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 2.0 * stddev_pop(close) OVER ({_BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS bb_lower,
  CASE WHEN rn >= 15 THEN {r6(f'avg(t) OVER ({_BW} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)')} END AS atr_14,
  CASE WHEN rn >= 26 THEN {r6(f'({_ema(12)}) - ({_ema(26)})')} END AS macd
FROM tr""",
    "multi_frequency_bars": f"""WITH {EV}
SELECT source, type || '_aggregated' AS type, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS "timestamp",
       date_trunc('hour', "timestamp") AS window_start,
       {r6('first(price ORDER BY "timestamp", event_id)')} AS open, {r6('max(price)')} AS high,
       {r6('min(price)')} AS low, {r6('first(price ORDER BY "timestamp" DESC, event_id DESC)')} AS close,
       {r6('CAST(sum(quantity) AS DOUBLE)')} AS volume, count(*) AS count,
       first(event_id ORDER BY "timestamp" DESC, event_id DESC) AS event_id
FROM ev GROUP BY 1, 2, 3, 4""",
    "sliding_window": f"""WITH {EV}, w AS (
  SELECT type, price, time_bucket(INTERVAL 15 MINUTE, "timestamp", TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS ws
  FROM ev, (SELECT unnest(range(0, 4)) AS k))
SELECT type, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS n, {r6('avg(price)')} AS mean
FROM w GROUP BY 1, 2""",
    "session_window": f"""WITH {EV},
g AS (SELECT *, CASE WHEN lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) IS NULL
                       OR "timestamp" - lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) > INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM ev),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS sid FROM g)
SELECT user_id, min("timestamp") AS session_start, max("timestamp") + INTERVAL 30 MINUTE AS session_end, count(*) AS n
FROM s GROUP BY user_id, sid""",
    "session_source": f"""WITH {EV},
g AS (SELECT *, lag("timestamp") OVER o AS before FROM ev WINDOW o AS (PARTITION BY source ORDER BY "timestamp", event_id)),
s AS (SELECT *, count(*) FILTER (before IS NULL OR "timestamp" - before > INTERVAL 10 MINUTE)
             OVER (PARTITION BY source ORDER BY "timestamp", event_id) AS sid FROM g)
SELECT source, min("timestamp") AS session_start, max("timestamp") + INTERVAL 10 MINUTE AS session_end, count(*) AS n
FROM s GROUP BY source, sid""",
    "bar_chain": f"""WITH {EV},
f AS (SELECT unnest(['1m', '5m', '1h', '24h']) AS frequency,
             unnest([INTERVAL 1 MINUTE, INTERVAL 5 MINUTE, INTERVAL 1 HOUR, INTERVAL 24 HOUR]) AS w),
b AS (SELECT *, time_bucket(w, "timestamp", TIMESTAMP '1970-01-01') AS window_start FROM ev, f)
SELECT frequency, source, type || '_aggregated' AS type, window_start + w AS "timestamp", window_start,
       {r6('first(price ORDER BY "timestamp", event_id)')} AS open, {r6('max(price)')} AS high,
       {r6('min(price)')} AS low, {r6('first(price ORDER BY "timestamp" DESC, event_id DESC)')} AS close,
       {r6('CAST(sum(quantity) AS DOUBLE)')} AS volume, count(*) AS count,
       first(event_id ORDER BY "timestamp" DESC, event_id DESC) AS event_id
FROM b GROUP BY frequency, source, type, window_start, w""",
    "trading_days": f"""WITH e AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events),
d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT d.day, count(e.day) AS n FROM d LEFT JOIN e USING (day)
WHERE dayofweek(d.day) NOT IN (0, 6) AND d.day NOT IN ({", ".join(f"DATE '{h}'" for h in HOLIDAYS)}) GROUP BY d.day""",
    "replay_paced": """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
p AS (SELECT i, k, 1700000000000000 + (i + k * (n - 1)) * 250000 AS us FROM o, (SELECT unnest([0, 1]) AS k))
SELECT 'replay-' || i || '-' || (us // 1000000) AS event_id, make_timestamp(us) AS "timestamp", i AS original_index,
       CAST(k AS INTEGER) AS pass_no FROM p""",
    "pattern_context": f"""WITH {EV}, {PATTERNS}
SELECT p.pattern_id, e.event_id AS r_event_id,
       {r6('(epoch_us(e."timestamp") - epoch_us(p."timestamp")) / 1e6')} AS offset_sec
FROM pt p JOIN ev e ON e.source = p.source
 AND e."timestamp" BETWEEN p."timestamp" - INTERVAL 5 MINUTE AND p."timestamp" + INTERVAL 5 MINUTE""",
    "align_on_ts": """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) AS r FROM lineitem GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.ts, b.ts) AS ts, round(a.r, 6) AS ship__revenue, b.n AS order__orders
FROM a FULL OUTER JOIN b ON a.ts = b.ts""",
    "cs_rank": f"""WITH {_SD}
SELECT ts, symbol, dense_rank() OVER (PARTITION BY ts ORDER BY revenue) AS revenue_rank,
       {r6('CASE WHEN max(qty) OVER (PARTITION BY ts) > min(qty) OVER (PARTITION BY ts) THEN (qty - min(qty) OVER (PARTITION BY ts)) / (max(qty) OVER (PARTITION BY ts) - min(qty) OVER (PARTITION BY ts)) END')} AS qty_rank
FROM sd""",
    "cs_zscore": f"""WITH {_SD}
SELECT ts, symbol, {r6('CASE WHEN stddev_samp(revenue) OVER (PARTITION BY ts) > 0 THEN (revenue - avg(revenue) OVER (PARTITION BY ts)) / stddev_samp(revenue) OVER (PARTITION BY ts) END')} AS revenue_z
FROM sd""",
    "winsorize": f"""WITH {_SD}, q AS (SELECT ts, quantile_cont(revenue, 0.1) AS lo, quantile_cont(revenue, 0.9) AS hi FROM sd GROUP BY ts)
SELECT ts, symbol, {r6('least(greatest(revenue, lo), hi)')} AS revenue_wins FROM sd JOIN q USING (ts)""",
    "neutralize": f"""WITH {_SD}
SELECT ts, symbol, {r6('revenue - avg(revenue) OVER (PARTITION BY ts, s_nationkey)')} AS revenue_neu FROM sd""",
    "topn_overlap": f"""WITH {_SD},
a AS (SELECT ts, symbol FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY revenue DESC, symbol) AS r FROM sd) WHERE r <= 5),
b AS (SELECT ts, symbol FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY qty DESC, symbol) AS r FROM sd) WHERE r <= 5)
SELECT a.ts, {r6('count(b.symbol) / count(*)')} AS overlap FROM a LEFT JOIN b ON a.ts = b.ts AND a.symbol = b.symbol
GROUP BY a.ts""",
    "keywords_topk": r"""WITH t AS (SELECT lang, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS token FROM documents),
c AS (SELECT lang, token, count(*) AS n FROM t WHERE length(token) >= 1 GROUP BY 1, 2)
SELECT * FROM (SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 20""",
    "return_stats": f"""WITH {EV},
d AS (SELECT type || '_aggregated' AS symbol, date_trunc('day', "timestamp") + INTERVAL 1 DAY AS ts,
             first(price ORDER BY "timestamp" DESC, event_id DESC) AS close FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n_, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret,
             close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM d),
s AS (SELECT symbol, count(ret) AS n, arg_min(close, n_) AS f, arg_max(close, n_) AS l, avg(ret) AS m,
             stddev_samp(ret) AS vol, min(dd) AS mdd, quantile_cont(ret, 0.05) AS q FROM r GROUP BY symbol),
e AS (SELECT r.symbol, avg(ret) AS es FROM r JOIN s USING (symbol) WHERE ret <= q GROUP BY r.symbol)
SELECT symbol, n, {r6('l / f - 1')} AS total_return, {r6('pow(l / f, 252.0 / n) - 1')} AS annual_return,
       {r6('vol')} AS vol, {r6('CASE WHEN vol > 0 THEN m / vol * sqrt(252) END')} AS sharpe, {r6('mdd')} AS max_drawdown,
       {r6('-q')} AS var_95, {r6('-es')} AS es_95
FROM s LEFT JOIN e USING (symbol)""",
    "trend": f"""WITH {EV}, r AS (SELECT *, CAST(row_number() OVER ({_TW}) AS DOUBLE) AS x FROM ev)
SELECT event_id,
  CASE WHEN x >= 20 THEN {r6(f'abs(regr_slope(price, x) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) / (stddev_pop(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(greatest(0.0, 1 - regr_r2(price, x) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))))')} END AS trend_strength,
  CASE WHEN x >= 20 THEN {r6(f'max(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - min(price) OVER ({_TW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS range_box,
  CASE WHEN x > 20 THEN price > max(price) OVER ({_TW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS breakout
FROM r""",
    "microstructure": """WITH t AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_extendedprice AS price, l_quantity AS quantity,
                  CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM lineitem),
g AS (SELECT symbol, date_trunc('day', ts) AS window_start, sum(price * quantity) / sum(quantity) AS vwap,
             sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) / sum(quantity) AS imbalance,
             max(price) AS h, min(price) AS l, arg_min(price, (ts, price, quantity)) AS o, arg_max(price, (ts, price, quantity)) AS c,
             sum(price * quantity) AS dollar_volume, count(DISTINCT ts) AS nts FROM t GROUP BY 1, 2)
SELECT symbol, window_start, round(vwap, 6) AS vwap, round(imbalance, 6) AS imbalance,
       round(sqrt(pow(ln(h / l), 2) / (4 * ln(2))), 6) AS parkinson,
       round(sqrt(greatest(pow(ln(h / l), 2) / 2 - (2 * ln(2) - 1) * pow(ln(c / o), 2), 0)), 6) AS garman_klass,
       round(abs(c / o - 1) / dollar_volume, 6) AS amihud, round(dollar_volume, 6) AS dollar_volume
FROM g""",
    "outliers_zscore": f"""WITH {EV}, s AS (SELECT type, avg(price) AS m, stddev_pop(price) AS sd FROM ev GROUP BY type)
SELECT event_id, type, {r6('price')} AS price FROM ev JOIN s USING (type) WHERE sd = 0 OR abs(price - m) <= 3.0 * sd""",
    "outliers_iqr": f"""WITH {EV}, s AS (SELECT type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM ev GROUP BY type)
SELECT event_id, type, {r6('price')} AS price FROM ev JOIN s USING (type)
WHERE price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)""",
    "pattern_report": f"""WITH {PATTERNS}
SELECT type, source, min("timestamp") AS first_seen, max("timestamp") AS last_seen,
       {r6('(epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6')} AS lifetime_sec, count(*) AS support,
       {r6('avg(confidence)')} AS mean_confidence FROM pt GROUP BY type, source""",
    "feedback_stats": f"""WITH {PATTERNS}, {FEEDBACK},
per AS (SELECT pattern_id, avg(rating) AS r, count(*) AS n FROM acc GROUP BY pattern_id)
SELECT type, count(*) AS patterns, sum(n) AS ratings, {r6('sum(r * n) / sum(n)')} AS mean_rating
FROM per JOIN (SELECT DISTINCT pattern_id, type FROM pt) USING (pattern_id) GROUP BY type""",
    "psi": f"""WITH {EV},
e AS (SELECT quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM ev
      WHERE "timestamp" < TIMESTAMP '2024-01-16 00:00:00'),
b AS (SELECT "timestamp" < TIMESTAMP '2024-01-16 00:00:00' AS base,
             len(list_filter(list_distinct(q), lambda x: price >= x)) AS bin FROM ev, e),
s AS (SELECT bin, count(*) FILTER (WHERE base) / (SELECT count(*) FROM b WHERE base) AS x,
             count(*) FILTER (WHERE NOT base) / (SELECT count(*) FROM b WHERE NOT base) AS y FROM b GROUP BY bin)
SELECT {r6('sum((greatest(x, 1e-6) - greatest(y, 1e-6)) * ln(greatest(x, 1e-6) / greatest(y, 1e-6)))')} AS psi,
       count(*) AS bins FROM s""",
    "snapshot_id": """SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus,
       CAST(o_totalprice AS DECIMAL(38,6)), epoch_us(o_orderdate), o_orderpriority)), 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS hash_sum
FROM orders""",
    "frequent_itemsets": """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, p_type AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT o, i AS last, i AS itemset FROM b
      UNION ALL SELECT r.o, b.i, r.itemset || '|' || b.i FROM r JOIN b ON r.o = b.o AND b.i > r.last)
SELECT itemset, count(*) AS freq FROM r GROUP BY itemset HAVING count(*) >= (SELECT ceil(0.01 * count(DISTINCT o)) FROM b)""",
    "feedback_by_pattern": f"""WITH {PATTERNS}, {FEEDBACK}
SELECT pattern_id, type, count(*) AS ratings, {r6('avg(rating)')} AS mean_rating, count(*) FILTER (WHERE rating > 0) AS positive,
       count(*) FILTER (WHERE rating < 0) AS negative
FROM acc JOIN (SELECT DISTINCT pattern_id, type FROM pt) USING (pattern_id) GROUP BY pattern_id, type""",
    "ddm_levels": f"""WITH {EVS},
e AS (SELECT *, row_number() OVER ({_TW}) AS n, (price > 100)::INT AS error FROM ev WHERE price IS NOT NULL),
p AS (SELECT *, sum(error) OVER ({_TW}) / n AS p FROM e),
s AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p),
m AS (SELECT *, min(CASE WHEN n >= 30 THEN (p + s, p, s) END) OVER ({_TW}) AS low FROM s)
SELECT event_id, type, {r6('p')} AS error_rate,
       CASE WHEN n >= 30 AND p + s > low[2] + 3.0 * low[3] THEN 'drift' WHEN n >= 30 AND p + s > low[2] + 2.0 * low[3] THEN 'warning'
            ELSE 'normal' END AS level FROM m""",
    "fusion_asof": f"""WITH {EV}
SELECT event_id, user_id, type, {", ".join(f"{r6(f'last_value(CASE WHEN type = {t!r} THEN price END IGNORE NULLS) OVER w')} AS {t}" for t in FUSED)}
FROM ev WHERE type IN {FUSED!r}
WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "frequent_sequences": f"""WITH {EV},
s AS (SELECT user_id, type, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS i FROM ev WHERE type IS NOT NULL),
l1 AS (SELECT user_id, type AS p, min(i) AS i FROM s GROUP BY ALL),
f1 AS (SELECT p, 1 AS length, count(*) AS support FROM l1 GROUP BY p HAVING count(*) >= {SEQUENCE_USERS}),
l2 AS (SELECT s.user_id, p || '>' || type AS p, min(s.i) AS i FROM l1 JOIN s ON s.user_id = l1.user_id AND s.i > l1.i WHERE p IN (SELECT p FROM f1) GROUP BY ALL),
f2 AS (SELECT p, 2 AS length, count(*) AS support FROM l2 GROUP BY p HAVING count(*) >= {SEQUENCE_USERS}),
l3 AS (SELECT s.user_id, p || '>' || type AS p, min(s.i) AS i FROM l2 JOIN s ON s.user_id = l2.user_id AND s.i > l2.i WHERE p IN (SELECT p FROM f2) GROUP BY ALL),
f3 AS (SELECT p, 3 AS length, count(*) AS support FROM l3 GROUP BY p HAVING count(*) >= {SEQUENCE_USERS})
SELECT p AS pattern, length, support FROM (FROM f1 UNION ALL FROM f2 UNION ALL FROM f3)""",
    "ddm_restart": f"""WITH RECURSIVE {EVS},
{ddm_sql('type')}
SELECT event_id, x.k AS type, {r6('e / n::DOUBLE')} AS error_rate, level, segment FROM ddm_r JOIN ddm_e AS x USING (k, i)""",
    "two_detectors": f"""WITH RECURSIVE {EVS},
{ddm_sql('source')},
a AS (SELECT * FROM ({drift_body('price')}) WHERE drift),
b AS (SELECT x.* FROM ddm_r JOIN ddm_e AS x USING (k, i) WHERE level = 'drift'),
m AS (SELECT count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE abs(epoch_us(a."timestamp") - epoch_us(b."timestamp")) <= 86400000000))
SELECT 'events' AS source, (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT n FROM m) AS matched,
       {r6('(SELECT n FROM m) / (SELECT count(*) FROM a)')} AS agreement""",
    "factor_select": f"""WITH {_SD},
f AS (SELECT ts, revenue, qty, revenue / qty AS unit, sqrt(qty) AS root, lead(revenue) OVER (PARTITION BY symbol ORDER BY ts) AS fwd FROM sd),
l AS ({" UNION ALL ".join(f"SELECT ts, '{c}' AS factor, {c} AS x, fwd FROM f" for c in ("revenue", "qty", "unit", "root"))}),
r AS (SELECT *, rank() OVER (PARTITION BY factor, ts ORDER BY x) AS ra, rank() OVER (PARTITION BY factor, ts ORDER BY fwd) AS rb
      FROM l WHERE x IS NOT NULL AND fwd IS NOT NULL),
i AS (SELECT factor, ts, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS ic FROM r GROUP BY ALL),
o AS (SELECT factor, ic, row_number() OVER (ORDER BY abs(ic) DESC, factor) AS o FROM (SELECT factor, avg(ic) AS ic FROM i GROUP BY factor)),
c AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM f" for a in ("revenue", "qty", "unit", "root") for b in ("revenue", "qty", "unit", "root") if a != b)}),
k1 AS (SELECT factor, o, NULL::VARCHAR AS rival FROM o WHERE o = 1),
k2 AS (SELECT * FROM k1 UNION ALL SELECT factor, o, (SELECT arg_min(k.factor, k.o) FROM k1 AS k JOIN c ON c.a = k.factor AND c.b = o.factor
       WHERE k.rival IS NULL AND c.c > 0.7) FROM o WHERE o = 2),
k3 AS (SELECT * FROM k2 UNION ALL SELECT factor, o, (SELECT arg_min(k.factor, k.o) FROM k2 AS k JOIN c ON c.a = k.factor AND c.b = o.factor
       WHERE k.rival IS NULL AND c.c > 0.7) FROM o WHERE o = 3),
k4 AS (SELECT * FROM k3 UNION ALL SELECT factor, o, (SELECT arg_min(k.factor, k.o) FROM k3 AS k JOIN c ON c.a = k.factor AND c.b = o.factor
       WHERE k.rival IS NULL AND c.c > 0.7) FROM o WHERE o = 4)
SELECT factor, {r6('ic')} AS ic, rival IS NULL AS kept, rival FROM k4 JOIN o USING (factor)""",
    "bootstrap_return": f"""WITH {EV},
g AS (SELECT type, "timestamp", event_id, ln((price + 100) / lag(price + 100) OVER ({_TW})) AS r FROM ev),
x AS (SELECT *, row_number() OVER ({_TW}) AS i, sum(r) OVER ({_TW} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS b FROM g WHERE r IS NOT NULL),
t AS (SELECT type, count(*) AS n, sum(r) AS s FROM x GROUP BY type),
d AS (SELECT type, n, n // 50 AS m, k, unnest(range(1, n // 50 + 1)) AS j FROM t, (SELECT unnest(range(1, 41)) AS k)),
p AS (SELECT *, ('0x' || substr(md5(type || '|' || k || '|' || j), 1, 13))::BIGINT % (n - 49) AS at FROM d),
u AS (SELECT p.type, k, exp(sum(b) * any_value(n) / (any_value(m) * 50)) - 1 AS v FROM p JOIN x ON x.type = p.type AND x.i - 50 = p.at GROUP BY ALL)
SELECT t.type, n, {r6('exp(any_value(s)) - 1')} AS total_return, {r6('quantile_cont(v, 0.025)')} AS low, {r6('quantile_cont(v, 0.975)')} AS high
FROM t JOIN u ON u.type = t.type GROUP BY t.type, n""",
    "detector_agreement": f"""WITH a AS (SELECT * FROM ({drift_body('price')}) WHERE drift), b AS (SELECT * FROM ({drift_body('quantity')}) WHERE drift),
m AS (SELECT source, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE abs(epoch_us(a."timestamp") - epoch_us(b."timestamp")) <= 3600000000)
      GROUP BY source)
SELECT 'events' AS source, (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, coalesce((SELECT n FROM m), 0) AS matched,
       {r6('coalesce((SELECT n FROM m), 0) / (SELECT count(*) FROM a)')} AS agreement""",
    "factor_screen": f"""WITH {_SD},
f AS (SELECT ts, revenue, CASE WHEN qty > 10 THEN qty END AS qty, lead(revenue) OVER (PARTITION BY symbol ORDER BY ts) AS fwd FROM sd),
l AS (SELECT ts, 'revenue' AS factor, revenue AS x, fwd FROM f UNION ALL SELECT ts, 'qty', qty, fwd FROM f),
r AS (SELECT *, rank() OVER (PARTITION BY factor, ts ORDER BY x) AS ra, rank() OVER (PARTITION BY factor, ts ORDER BY fwd) AS rb
      FROM l WHERE x IS NOT NULL AND fwd IS NOT NULL),
i AS (SELECT factor, ts, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS ic FROM r GROUP BY ALL)
SELECT factor, {r6('avg(ic)')} AS ic, {r6('avg(ic) / stddev_samp(ic)')} AS ic_ir,
       {r6('(SELECT avg((x IS NULL)::INT) FROM l WHERE l.factor = i.factor)')} AS missing, count(ic) AS points FROM i GROUP BY factor""",
    "bootstrap_mean": f"""WITH {EV},
d AS (SELECT type, price, k, ('0x' || substr(md5(event_id || '|' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM ev, (SELECT unnest(range(1, 51)) AS k) WHERE price IS NOT NULL),
m AS (SELECT type, k, sum(price * w) / sum(w) AS m FROM (
        SELECT type, k, price, len(list_filter({POISSON1_CDF!r}::DOUBLE[], lambda c: u >= c)) AS w FROM d) GROUP BY ALL)
SELECT type, {r6('avg(m)')} AS mean, {r6('quantile_cont(m, 0.025)')} AS low, {r6('quantile_cont(m, 0.975)')} AS high FROM m GROUP BY type""",
    "retention": f"""WITH {EV} SELECT event_id, "timestamp" FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-14 00:00:00'""",
    "replay_window": f"""WITH {EV},
w AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS i FROM ev
      WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-07 00:00:00')
SELECT 'replay-' || i || '-0' AS event_id, 'events_replay' AS source, 'replay' AS type, event_id AS original FROM w""",
    "align_common": """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) AS r FROM lineitem GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS n FROM orders GROUP BY 1)
SELECT ts, round(a.r, 6) AS ship__revenue, b.n AS order__orders FROM a JOIN b USING (ts)""",
    "obv": f"""WITH {EV},
hb AS (SELECT source, type || '_aggregated' AS type, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS "timestamp",
              first(event_id ORDER BY "timestamp" DESC, event_id DESC) AS event_id,
              first(price ORDER BY "timestamp" DESC, event_id DESC) AS close, CAST(sum(quantity) AS DOUBLE) AS volume
       FROM ev GROUP BY 1, 2, 3),
d AS (SELECT *, coalesce(sign(close - lag(close) OVER ({_BW})) * volume, 0) AS v FROM hb)
SELECT event_id, type, {r6(f'sum(v) OVER ({_BW})')} AS obv FROM d""",
    "realised_volatility": f"""WITH {EV},
r AS (SELECT type, "timestamp", ln((price + 100) / lag(price + 100) OVER ({_TW})) AS r FROM ev)
SELECT type, date_trunc('day', "timestamp") AS window_start, {r6('sqrt(sum(r * r))')} AS realised_vol, count(r) AS n FROM r GROUP BY ALL""",
    "business_days": """SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)),
       max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders) WHERE dayofweek(d) NOT IN (0, 6)""",
    "dead_letter": """SELECT CAST(event_id AS VARCHAR) AS event_id,
       CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing_payload:k' ELSE 'missing_payload:price' END AS reason
FROM events WHERE json_extract(props, '$.k') IS NULL OR json_extract(props, '$.price') IS NULL""",
}
