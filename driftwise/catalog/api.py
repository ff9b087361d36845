"""Catalog: pattern table, explanations, query API, feedback and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..detectors.explain import TEMPLATES, explain
from ..functions.ids import stable_id
from ..plans.engine import PatternEngine
from ..plans.monitor import (event_counters, feedback_labels, last_gauge, latency_histogram, latency_sketches, latency_stats,
                             sketch_stats, status_rollup)
from ..plans.query import (accept_feedback, get_events, get_pattern, get_pattern_types, get_patterns,
                           get_sources, overview, short_view)
from ..sources.tables import events_envelope, events_raw_json, lineitem_envelope, table
from .common import EV, finish, r6, sql_fill
from .detect import CENTROIDS, CLUSTER_THRESHOLD, CLUSTER_WINDOW, HST, cluster_body, hst_body

EVENTS_FILTER = dict(source="events", event_type="click", start_time="2024-01-10 00:00:00",
                     end_time="2024-01-20 12:00:00", limit=100)
LATENCY_BUCKETS = (1.0, 7.0, 30.0, 60.0, 90.0, 120.0)


PATTERN_CONFIG = {"detectors": [
    {"name": "cluster", "type": "cluster_detector", "source": "events",
     "config": {"features": ["price", "quantity"], "window_size": CLUSTER_WINDOW, "threshold": CLUSTER_THRESHOLD, "centroids": CENTROIDS}},
    {"name": "anomaly", "type": "half_space_trees", "source": "events",
     "config": {"features": ["price"], "n_trees": HST["n_trees"], "height": HST["height"], "window_size": HST["window_size"],
                "seed": HST["seed"], "scale": "all"}}]}


def patterns_table(spark, sf):
    """Patterns found on the events table: cluster-regime changes (price,
    quantity) and HST anomalies (price) with the adaptive threshold."""
    return PatternEngine(PATTERN_CONFIG).detect(events_envelope(spark, sf))


def feedback_table(spark, sf):
    """Feedback submissions derived from events: each event rates the cluster
    pattern its own id would have produced (so only some exist); rating
    ``event_id % 4 - 1`` (2 is out of range)."""
    ev = table(spark, sf, "events")
    return ev.select(
        stable_id(F.lit("events"), F.lit("cluster"), F.col("event_id").cast("string")).alias("pattern_id"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("event_id") % 4 - 1).cast("int").alias("rating"),
        F.col("event_type").alias("comment"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").cast("string").alias("submission"),
    )


FB_IDS = ("pattern_id", "user_id", "comment", "submission")


def q_explain_patterns(spark, sf):
    return finish(explain(patterns_table(spark, sf)).select("pattern_id", "type", "timestamp", "explanation"))


def q_events_query(spark, sf):
    out = get_events(events_envelope(spark, sf), **EVENTS_FILTER)
    return finish(out.select("event_id", "type", "timestamp", F.col("payload.price").alias("price")))


def q_events_decoded(spark, sf):
    """The newest events of the raw feed as decoded records."""
    out = get_events(events_raw_json(spark, sf), event_type="click", limit=200, decoded=True)
    return finish(out.select("event_id", F.col("timestamp").alias("time"), F.expr("variant_get(payload, '$.k', 'bigint')").alias("k")))


def q_patterns_query(spark, sf):
    out = get_patterns(patterns_table(spark, sf), pattern_type="anomaly", limit=50)
    return finish(out.select("pattern_id", "type", "timestamp", "explanation"))


def q_pattern_by_id(spark, sf):
    pats = patterns_table(spark, sf)
    newest = (pats.filter(F.col("type") == "cluster_change")
              .orderBy(F.col("timestamp").desc(), F.col("pattern_id").desc()).select("pattern_id").take(1))
    pid = newest[0]["pattern_id"] if newest else ""
    return finish(get_pattern(pats, pid).select("pattern_id", "type", "timestamp", "source", "explanation"))


def _two_sources(spark, sf):
    cols = ["event_id", "source", "type", "timestamp"]
    return events_envelope(spark, sf).select(*cols).unionByName(lineitem_envelope(spark, sf).select(*cols))


def q_distinct_sources(spark, sf):
    return get_sources(_two_sources(spark, sf))


def q_pattern_types(spark, sf):
    return get_pattern_types(patterns_table(spark, sf))


def q_overview(spark, sf):
    return overview(_two_sources(spark, sf), patterns_table(spark, sf))


def q_feedback_valid(spark, sf):
    acc, _ = accept_feedback(feedback_table(spark, sf), patterns_table(spark, sf), id_cols=FB_IDS)
    return finish(acc)


def q_feedback_rejected(spark, sf):
    _, rej = accept_feedback(feedback_table(spark, sf), patterns_table(spark, sf), id_cols=FB_IDS)
    return finish(rej.select("pattern_id", "submission", "rating", "reason"))


def q_feedback_labels(spark, sf):
    acc, _ = accept_feedback(feedback_table(spark, sf), patterns_table(spark, sf), id_cols=FB_IDS)
    return feedback_labels(acc)


def q_event_counters(spark, sf):
    return event_counters(_two_sources(spark, sf), ("source", "type"))


def ship_latency(spark, sf):
    """lineitem x orders: days from order to shipment, per return flag."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    lat = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86_400e6
    return j.select(F.col("l_returnflag").alias("type"), lat.alias("latency_days"), "l_shipdate")


def q_latency_histogram(spark, sf):
    return finish(latency_histogram(ship_latency(spark, sf), "latency_days", ["type"], LATENCY_BUCKETS))


def q_latency_stats(spark, sf):
    return finish(latency_stats(ship_latency(spark, sf), "latency_days", ["type"]))


def q_sketch_stats(spark, sf):
    """Latencies shipped in 1995, from daily sketches (the exact columns)."""
    daily = latency_sketches(ship_latency(spark, sf), "latency_days", ["type"], "l_shipdate", "day")
    out = sketch_stats(daily, ["type"], "1995-01-01 00:00:00", "1996-01-01 00:00:00")
    return finish(out.select("type", "count", "min", "max", "mean"))


def q_queue_last(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("queue"), F.col("value").alias("size"),
                                           "ts", "event_id")
    return finish(last_gauge(ev, "queue", "size", ("ts", "event_id")))


def q_status_rollup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("component"))
    lab = table(spark, sf, "labels")
    st = docs.join(lab, "doc_id", "left").select(
        "component",
        F.when(F.col("toxic") == 1, "unhealthy").when(F.col("quality") == 1, "healthy").otherwise("unknown")
        .alias("status"))
    return status_rollup(st, "status", ["component"])


def q_short_view(spark, sf):
    pats = explain(patterns_table(spark, sf))
    return short_view(pats).select("pattern_id", "short_id", "confidence_pct", "short_explanation")


# ---------------------------------------------------------------- oracle SQL

_T = TEMPLATES["zh"]
_TIME = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S')"
_EXPLAIN = f"""CASE type
  WHEN 'cluster_change' THEN {sql_fill(_T['cluster_change'], time=_TIME, source='source')}
       || {sql_fill(_T['cluster_move'], prev='CAST(prev_cluster AS VARCHAR)', new='CAST(new_cluster AS VARCHAR)')}
       || {sql_fill(_T['contributors'], contributors="'price (0.50), quantity (0.50)'")}
       || {sql_fill(_T['confidence'], confidence="printf('%.2f', confidence)")}
  WHEN 'anomaly' THEN {sql_fill(_T['anomaly'], time=_TIME, source='source')}
       || {sql_fill(_T['anomaly_score'], score="printf('%.2f', score)", threshold="printf('%.2f', threshold)")}
       || {sql_fill(_T['contributors'], contributors="'price (1.00)'")}
       || {sql_fill(_T['confidence'], confidence="printf('%.2f', confidence)")}
END"""

_TW = 'PARTITION BY source ORDER BY "timestamp", event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW'

PATTERNS = f"""cl AS (SELECT * FROM ({cluster_body()})),
sc AS (SELECT * FROM ({hst_body()})),
th AS (SELECT *, CASE WHEN count(score) OVER ({_TW}) > 10 THEN quantile_cont(score, 0.95) OVER ({_TW})
                      ELSE 0.5 END AS threshold FROM sc),
pt AS (
  SELECT md5(concat_ws('|', 'events', 'cluster', event_id)) AS pattern_id, 'cluster_change' AS type,
         "timestamp", 'events' AS source, prev_cluster, dominant AS new_cluster, ratio AS confidence,
         CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS threshold FROM cl
  UNION ALL
  SELECT md5(concat_ws('|', 'events', 'anomaly', event_id)), 'anomaly', "timestamp", 'events', NULL, NULL,
         CASE WHEN threshold < 1 THEN (score - threshold) / (1 - threshold) ELSE 0.5 END, score, threshold
  FROM th WHERE score > threshold),
px AS (SELECT *, {_EXPLAIN} AS explanation FROM pt)"""

FEEDBACK = f"""fb AS (
  SELECT md5(concat_ws('|', 'events', 'cluster', CAST(event_id AS VARCHAR))) AS pattern_id,
         CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 4 - 1 AS INTEGER) AS rating,
         event_type AS comment, ts AS "timestamp", CAST(event_id AS VARCHAR) AS submission FROM events),
acc AS (
  SELECT md5(concat_ws('|', pattern_id, user_id, comment, submission)) AS feedback_id, pattern_id, "timestamp",
         user_id, CAST(rating AS TINYINT) AS rating, comment
  FROM fb WHERE rating BETWEEN -1 AND 1 AND pattern_id IN (SELECT pattern_id FROM pt))"""

TWO = f"""{EV},
li2 AS (SELECT 'lineitem' AS source, l_returnflag AS type FROM lineitem),
two AS (SELECT source, type FROM ev UNION ALL SELECT source, type FROM li2)"""

SHIP = """sl AS (SELECT l_returnflag AS type, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6 AS latency_days, l_shipdate
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_HIST = ", ".join(f"sum(CASE WHEN latency_days <= {b} THEN 1 ELSE 0 END) AS \"le_{b}\"" for b in LATENCY_BUCKETS)

QUERIES = {
    "explain_patterns": q_explain_patterns,
    "events_decoded": q_events_decoded,
    "events_query": q_events_query,
    "patterns_query": q_patterns_query,
    "pattern_by_id": q_pattern_by_id,
    "distinct_sources": q_distinct_sources,
    "pattern_types": q_pattern_types,
    "overview": q_overview,
    "feedback_valid": q_feedback_valid,
    "feedback_rejected": q_feedback_rejected,
    "feedback_labels": q_feedback_labels,
    "event_counters": q_event_counters,
    "latency_histogram": q_latency_histogram,
    "latency_stats": q_latency_stats,
    "sketch_stats": q_sketch_stats,
    "queue_last": q_queue_last,
    "status_rollup": q_status_rollup,
    "short_view": q_short_view,
}

ORACLE = {
    "events_decoded": """SELECT CAST(event_id AS VARCHAR) AS event_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS time,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type = 'click' ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 200""",
    "explain_patterns": f"WITH {PATTERNS} SELECT pattern_id, type, \"timestamp\", explanation FROM px",
    "events_query": f"""WITH {EV}
SELECT event_id, type, "timestamp", {r6('price')} AS price FROM ev
WHERE source = 'events' AND type = 'click' AND "timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
  AND "timestamp" <= TIMESTAMP '2024-01-20 12:00:00'
ORDER BY "timestamp" DESC, event_id DESC LIMIT 100""",
    "patterns_query": f"""WITH {PATTERNS}
SELECT pattern_id, type, "timestamp", explanation FROM px WHERE type = 'anomaly'
ORDER BY "timestamp" DESC, pattern_id DESC LIMIT 50""",
    "pattern_by_id": f"""WITH {PATTERNS}
SELECT pattern_id, type, "timestamp", source, explanation FROM px
WHERE pattern_id = (SELECT pattern_id FROM px WHERE type = 'cluster_change'
                    ORDER BY "timestamp" DESC, pattern_id DESC LIMIT 1)""",
    "distinct_sources": f"WITH {TWO} SELECT DISTINCT source AS name FROM two",
    "pattern_types": f"WITH {PATTERNS} SELECT DISTINCT type AS name FROM pt",
    "overview": f"""WITH {TWO}, {PATTERNS}
SELECT (SELECT count(*) FROM two) AS events, (SELECT count(DISTINCT source) FROM two) AS sources,
       (SELECT count(*) FROM pt) AS patterns, (SELECT count(DISTINCT type) FROM pt) AS pattern_types""",
    "feedback_valid": f"WITH {PATTERNS}, {FEEDBACK} SELECT * FROM acc",
    "feedback_rejected": f"""WITH {PATTERNS}, {FEEDBACK}
SELECT pattern_id, submission, rating,
       CASE WHEN rating NOT BETWEEN -1 AND 1 THEN 'invalid_rating' ELSE 'pattern_not_found' END AS reason
FROM fb WHERE rating NOT BETWEEN -1 AND 1 OR pattern_id NOT IN (SELECT pattern_id FROM pt)""",
    "feedback_labels": f"""WITH {PATTERNS}, {FEEDBACK}
SELECT CASE WHEN rating = -1 THEN 'negative' WHEN rating = 0 THEN 'neutral' ELSE 'positive' END AS label,
       count(*) AS count FROM acc GROUP BY 1""",
    "event_counters": f"WITH {TWO} SELECT source, type, count(*) AS count FROM two GROUP BY source, type",
    "latency_histogram": f"""WITH {SHIP}
SELECT type, {_HIST}, count(latency_days) AS count, {r6('sum(latency_days)')} AS sum FROM sl GROUP BY type""",
    "latency_stats": f"""WITH {SHIP}
SELECT type, count(latency_days) AS count, {r6('min(latency_days)')} AS min, {r6('max(latency_days)')} AS max,
       {r6('avg(latency_days)')} AS mean, {r6('quantile_cont(latency_days, 0.5)')} AS median,
       {r6('quantile_cont(latency_days, 0.95)')} AS p95, {r6('quantile_cont(latency_days, 0.99)')} AS p99
FROM sl GROUP BY type""",
    "sketch_stats": f"""WITH {SHIP}
SELECT type, count(latency_days) AS count, {r6('min(latency_days)')} AS min, {r6('max(latency_days)')} AS max, {r6('avg(latency_days)')} AS mean
FROM sl WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01' GROUP BY type""",
    "queue_last": """SELECT event_type AS queue, round(arg_max(value, (ts, event_id)), 6) AS value
FROM events GROUP BY event_type""",
    "status_rollup": """SELECT d.source AS component,
       CASE max(CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 0 ELSE 1 END)
            WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'unknown' ELSE 'healthy' END AS status,
       count(*) AS components
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""",
    "short_view": f"""WITH {PATTERNS}
SELECT pattern_id, substr(pattern_id, 1, 8) || '...' AS short_id,
       CAST(CAST(round(coalesce(confidence, 0.5) * 100) AS BIGINT) AS VARCHAR) || '%' AS confidence_pct,
       CASE WHEN length(explanation) > 50 THEN substr(explanation, 1, 50) || '...' ELSE explanation END
         AS short_explanation
FROM px""",
}
