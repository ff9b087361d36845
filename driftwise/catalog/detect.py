"""Catalog: adaptive threshold, adjacent-frame drift, cluster change, HST scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..detectors.adwin import adwin_flags
from ..detectors.adwin_merged import CELL, PER_LEVEL, adwin_merged_flags
from ..detectors.cluster import cluster_changes, cluster_windows
from ..detectors.common import ORDER, adaptive_threshold
from ..detectors.drift import adwin_epsilon, detect_drift_adjacent, drift_flags
from ..detectors.explain import TEMPLATES, explain
from ..detectors.hst import build_trees, hst_scores, scale_by_key
from ..sources.tables import events_envelope, events_shifted
from .common import EV, EVS, finish, r6, sql_fill

# Query parameters (fixed per query; the operators take them as arguments).
CENTROIDS = [[25.0, 25.0], [25.0, 75.0], [100.0, 25.0], [100.0, 75.0]]
CLUSTER_WINDOW = 50
CLUSTER_THRESHOLD = 0.3
LEARNED = 4
DRIFT_FRAME = 50
DRIFT_DELTA = 0.002
DRIFT_GRACE = 100
HST = dict(n_trees=10, height=8, window_size=100, seed=7)


def q_adaptive_threshold(spark, sf):
    ev = events_envelope(spark, sf).withColumn("score", F.col("payload.price"))
    out = adaptive_threshold(ev, "score", q=0.95, window=100)
    return finish(out.select("event_id", "score", "threshold", "alert"))


def q_drift_adjacent(spark, sf):
    """Both means and the flag of every event, over a series with a level shift."""
    fl = drift_flags(events_shifted(spark, sf), "price", DRIFT_FRAME, DRIFT_DELTA, DRIFT_GRACE)
    return finish(fl.select("event_id", "timestamp", "prev_mean", "new_mean", "change_pct", "drift"))


def q_explain_drift(spark, sf):
    """Drift patterns of two fields over the shifted series, explained."""
    pats = detect_drift_adjacent(events_shifted(spark, sf), ["price", "quantity"], "drift", DRIFT_FRAME, DRIFT_DELTA,
                                 DRIFT_GRACE)
    return finish(explain(pats).select("pattern_id", "type", "detector_type", "timestamp", "explanation"))


def q_cluster_change(spark, sf):
    ch = cluster_windows(events_envelope(spark, sf), ["price", "quantity"], CENTROIDS, CLUSTER_WINDOW,
                         CLUSTER_THRESHOLD)
    return finish(ch.select("event_id", "timestamp", "cluster", "dominant", "ratio", "prev_cluster"))


def q_cluster_learned(spark, sf):
    """Regime changes of clusters that are learned block by block from earlier rows."""
    ch, _ = cluster_changes(events_envelope(spark, sf), {}, ["price", "quantity"], LEARNED, CLUSTER_WINDOW, CLUSTER_THRESHOLD,
                            ["source"], list(ORDER))
    return finish(ch.select("event_id", "timestamp", "cluster", "dominant", "ratio", "prev_cluster"))


def q_hst_scores(spark, sf):
    ev = scale_by_key(events_envelope(spark, sf), ["price"])
    s = hst_scores(ev, ["price_scaled"], **HST)
    return finish(s.select("event_id", "score"))


_W = 'PARTITION BY source ORDER BY "timestamp", event_id'


def drift_body(field: str = "price") -> str:
    """Rows of ``ev`` with both means, change and flag (unrounded)."""
    a, b = adwin_epsilon(DRIFT_FRAME, DRIFT_FRAME, DRIFT_DELTA)
    n = DRIFT_FRAME
    start = max(2 * n, DRIFT_GRACE)
    old = f"avg({field}) OVER ({_W} ROWS BETWEEN {2 * n - 1} PRECEDING AND {n} PRECEDING)"
    new = f"avg({field}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    var = f"var_pop({field}) OVER ({_W} ROWS BETWEEN {2 * n - 1} PRECEDING AND CURRENT ROW)"
    return f"""WITH {EVS},
f AS (SELECT *, row_number() OVER ({_W}) AS rn, {old} AS prev_mean, {new} AS new_mean, {var} AS v FROM ev),
c AS (SELECT *, coalesce(rn >= {start} AND abs(new_mean - prev_mean) > sqrt({a!r} * v) + {b!r}, false) AS cut FROM f),
d AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER ({_W}), false) AS drift FROM c)
SELECT event_id, "timestamp", source, prev_mean, new_mean,
       CASE WHEN prev_mean <> 0 THEN (new_mean - prev_mean) / abs(prev_mean) * 100 ELSE 0.0 END AS change_pct, drift
FROM d"""


def explain_drift_sql() -> str:
    """Patterns and their text: the field with the largest change is named, all are contributors."""
    t = TEMPLATES["zh"]
    fields = ("price", "quantity")
    parts = " UNION ALL ".join(f"SELECT '{f}' AS field, * FROM ({drift_body(f)}) WHERE drift" for f in fields)
    best = "arg_max({}, (abs(change_pct), field = 'price'))"
    change = sql_fill(t["drift_change"], field="field", prev="printf('%.2f', prev_mean)",
                      direction=f"CASE WHEN change_pct > 0 THEN '{t['up']}' ELSE '{t['down']}' END",
                      new="printf('%.2f', new_mean)", pct="printf('%.2f', abs(change_pct))")
    return f"""WITH f AS ({parts}),
g AS (SELECT event_id, source, "timestamp", {", ".join(best.format(c) + f" AS {c}" for c in ("prev_mean", "new_mean", "change_pct"))},
             {best.format("field")} AS field,
             string_agg(field || ' (' || printf('%.2f', 1.0 / n) || ')', ', ' ORDER BY field) AS who
      FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM f) GROUP BY ALL)
SELECT md5(concat_ws('|', source, 'drift', event_id)) AS pattern_id, 'drift' AS type, 'adwin' AS detector_type, "timestamp",
       {sql_fill(t["drift"], time="strftime(timestamp, '%Y-%m-%d %H:%M:%S')", source="source")} || {change}
       || {sql_fill(t["contributors"], contributors="who")} || {sql_fill(t["confidence"], confidence="'0.90'")} AS explanation
FROM g"""


def nearest_sql(points) -> str:
    """Index of the nearest of ``points`` (pairs of SQL terms); ties -> lowest index."""
    d = [f"((price - {x}) * (price - {x}) + (quantity - {y}) * (quantity - {y}))" for x, y in points]
    return "CASE " + " ".join(f"WHEN {t} = least({', '.join(d)}) THEN {k}" for k, t in enumerate(d)) + " END"


def regime_sql(k: int, first: int) -> str:
    """From ``p`` (rows with rn and cluster, predicted from row ``first`` on) to the changes."""
    w = CLUSTER_WINDOW
    full = first + w - 1
    fr = f"{_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW"
    cnts = ", ".join(f"sum(CASE WHEN cluster = {c} THEN 1 ELSE 0 END) OVER ({fr}) AS n{c}, "
                     f"min(CASE WHEN cluster = {c} THEN rn END) OVER ({fr}) AS f{c}" for c in range(k))
    # dominant: max count, ties -> smallest first position in the window
    cand = ", ".join(f"CASE WHEN n{c} > 0 THEN (n{c}, -f{c}, {c}) END" for c in range(k))
    return f"""c AS (SELECT *, {cnts} FROM p),
g AS (SELECT *, greatest({cand}) AS dom FROM c),
h AS (SELECT *, CASE WHEN rn >= {full} THEN dom[3] END AS dominant,
             CASE WHEN rn >= {full} THEN dom[1] / {float(w)} END AS ratio FROM g),
e AS (SELECT *, CASE WHEN rn = {first} THEN cluster ELSE dominant END AS reg FROM h
      WHERE rn = {first} OR ratio >= {CLUSTER_THRESHOLD}),
l AS (SELECT *, lag(reg) OVER ({_W}) AS prev_cluster FROM e)
SELECT event_id, "timestamp", cluster, dominant, ratio, prev_cluster
FROM l WHERE ratio >= {CLUSTER_THRESHOLD} AND dominant <> prev_cluster"""


def cluster_body() -> str:
    """Cluster-change rows (unrounded): event_id, timestamp, cluster, dominant, ratio, prev_cluster."""
    w = CLUSTER_WINDOW
    return f"""WITH {EV},
r AS (SELECT *, row_number() OVER ({_W}) AS rn FROM ev WHERE price IS NOT NULL AND quantity IS NOT NULL),
p AS (SELECT *, CASE WHEN rn >= {w} THEN {nearest_sql(CENTROIDS)} END AS cluster FROM r),
{regime_sql(len(CENTROIDS), w)}"""


def cluster_learned_body() -> str:
    """The same with anchors from the first block (farthest-first), sums of each block's rows
    per anchor, and centroids from the blocks before."""
    w, k = CLUSTER_WINDOW, LEARNED
    anchors = ["a0 AS (SELECT price AS p0, quantity AS q0 FROM r WHERE rn = 1)"]
    for i in range(1, k):
        near = ", ".join(f"(price - p{j}) * (price - p{j}) + (quantity - q{j}) * (quantity - q{j})" for j in range(i))
        anchors.append(f"a{i} AS (SELECT a{i - 1}.*, price AS p{i}, quantity AS q{i} FROM r CROSS JOIN a{i - 1} WHERE rn <= {w} "
                       f"ORDER BY least({near}) DESC, rn LIMIT 1)")
    cells = nearest_sql([(f"p{i}", f"q{i}") for i in range(k)])
    cents = ", ".join(f"coalesce(sum(CASE WHEN s.cell = {i} THEN s.price END) / sum(CASE WHEN s.cell = {i} THEN s.n END), any_value(p{i})) AS x{i}, "
                      f"coalesce(sum(CASE WHEN s.cell = {i} THEN s.quantity END) / sum(CASE WHEN s.cell = {i} THEN s.n END), any_value(q{i})) AS y{i}"
                      for i in range(k))
    pred = nearest_sql([(f"x{i}", f"y{i}") for i in range(k)])
    return f"""WITH {EV},
r AS (SELECT *, row_number() OVER ({_W}) AS rn FROM ev WHERE price IS NOT NULL AND quantity IS NOT NULL),
{", ".join(anchors)},
cl AS (SELECT (rn - 1) // {w} AS b, {cells} AS cell, price, quantity FROM r CROSS JOIN a{k - 1}),
s AS (SELECT b, cell, sum(price) AS price, sum(quantity)::DOUBLE AS quantity, count(*) AS n FROM cl GROUP BY ALL),
bl AS (SELECT DISTINCT b FROM cl),
ct AS (SELECT bl.b, {cents} FROM bl CROSS JOIN a{k - 1} LEFT JOIN s ON s.b < bl.b GROUP BY bl.b),
p AS (SELECT r.*, CASE WHEN rn > {w} THEN {pred} END AS cluster FROM r JOIN ct ON ct.b = (rn - 1) // {w}),
{regime_sql(k, w + 1)}"""


def hst_body() -> str:
    """HST scores (unrounded): source, event_id, timestamp, score."""
    p = HST
    n_trees, height, win = p["n_trees"], p["height"], p["window_size"]
    trees = build_trees(1, n_trees, height, p["seed"])
    vals = ", ".join(f"({t}, [{', '.join(repr(float(s)) for s in sp)}])" for t, (_, sp) in enumerate(trees))
    steps = []
    for d in range(1, height + 1):
        cur = f"(2 * n{d - 1} + CASE WHEN x >= list_extract(splits, n{d - 1} + 1) THEN 1 ELSE 0 END)"
        steps.append(f"s{d} AS (SELECT *, {cur} AS n{d} FROM s{d - 1})")
    node_list = "[" + ", ".join(f"n{d}" for d in range(height + 1)) + "]"
    limit = 0.1 * win
    norm = float(n_trees * win * 2 ** height)
    return f"""WITH {EV},
mm AS (SELECT source, min(price) AS lo, max(price) AS hi FROM ev GROUP BY source),
sc AS (SELECT ev.*, CASE WHEN hi > lo THEN (price - lo) / (hi - lo) ELSE 0.0 END AS x
       FROM ev JOIN mm USING (source) WHERE price IS NOT NULL),
r AS (SELECT *, row_number() OVER ({_W}) AS rn FROM sc),
trees(tree, splits) AS (VALUES {vals}),
s0 AS (SELECT r.*, (rn - 1) // {win} AS blk, tree, splits, 1 AS n0 FROM r CROSS JOIN trees),
{', '.join(steps)},
ex AS (SELECT source, event_id, "timestamp", blk, tree, unnest(range(0, {height + 1})) AS depth,
              unnest({node_list}) AS node FROM s{height}),
mass AS (SELECT source, blk + 1 AS blk, tree, node, count(*) AS m FROM ex GROUP BY ALL),
j AS (SELECT ex.*, coalesce(mass.m, 0) AS m FROM ex LEFT JOIN mass USING (source, blk, tree, node)
      WHERE ex.blk >= 1),
t AS (SELECT source, event_id, "timestamp", tree,
             arg_min(m * pow(2.0, depth), CASE WHEN m <= {limit} OR depth = {height} THEN depth END) AS v
      FROM j GROUP BY ALL)
SELECT source, event_id, "timestamp", 1.0 - sum(v) / {norm} AS score FROM t GROUP BY ALL"""


def q_adwin_drift(spark, sf):
    """Exact sequential ADWIN on the shifted price, a sequence per event type (no SQL
    oracle: rows-only check here; tests compare it with a plain-Python run)."""
    fl = adwin_flags(events_shifted(spark, sf), ["price"], DRIFT_DELTA, DRIFT_GRACE, key=("source", "type"))
    return finish(fl.select("event_id", "timestamp", "field", "prev_mean", "new_mean", "change_pct", "width"))


def q_adwin_merged(spark, sf):
    """ADWIN over mergeable buckets, the whole source as one key, both fields shifted; small
    chunks, so that the key is run in several."""
    fl = adwin_merged_flags(events_shifted(spark, sf), ["price", "quantity"], DRIFT_DELTA, DRIFT_GRACE, chunk=64)
    return finish(fl.select("event_id", "timestamp", "field", "prev_mean", "new_mean", "change_pct", "width"))


def adwin_merged_body() -> str:
    """Cuts by recursion over (end, start): a step either drops the oldest bucket or goes on
    to the next cell. Means and variances come from running sums at the cells."""
    c = CELL
    var = "greatest(((z.q - a.q) - (z.p - a.p) * (z.p - a.p) / z.w) / z.w, 0.0)"
    ln = f"ln(2.0 * ln(z.w) / {DRIFT_DELTA!r})"
    m = "(1.0 / z.n0 + 1.0 / (z.w - z.n0))"
    return f"""WITH RECURSIVE {EVS},
v AS (SELECT *, row_number() OVER ({_W}) AS n FROM ev WHERE price IS NOT NULL OR quantity IS NOT NULL),
l AS (SELECT source, event_id, "timestamp", n, 'price' AS field, CAST(price AS DOUBLE) AS x FROM v
      UNION ALL SELECT source, event_id, "timestamp", n, 'quantity', CAST(quantity AS DOUBLE) FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY "timestamp", event_id) AS pos
      FROM l WHERE n >= {DRIFT_GRACE} AND x IS NOT NULL),
s AS (SELECT *, sum(x) OVER r AS p, sum(x * x) OVER r AS q FROM o WINDOW r AS (PARTITION BY source, field ORDER BY pos)),
e AS (SELECT source, field, pos // {c} AS cell, event_id, "timestamp", p, q FROM s WHERE pos % {c} = 0
      UNION ALL SELECT DISTINCT source, field, 0, NULL, CAST(NULL AS TIMESTAMP), 0.0, 0.0 FROM o),
g AS (SELECT source, field, cell, cell & (-cell) AS size, p, q FROM e),
run(source, field, "end", "start") AS (
  SELECT source, field, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM g WHERE cell = 1
  UNION ALL
  SELECT source, field, CASE WHEN cut THEN "end" ELSE "end" + 1 END, CASE WHEN cut THEN oldest ELSE "start" END
  FROM (SELECT z.source, z.field, z."end", z."start", min(z.cell) AS oldest,
               coalesce(bool_or(abs((z.ep - a.p) / z.n0 - (z.p - z.ep) / (z.w - z.n0))
                                > sqrt(2.0 * {m} * {var} * {ln}) + 2.0 / 3.0 * {m} * {ln}), false) AS cut
        FROM (SELECT r.source, r.field, r."end", r."start", b.p, b.q, ({c} * (r."end" - r."start")) AS w,
                     x.cell, x.p AS ep, {c} * (x.cell - r."start") AS n0
              FROM run r JOIN g b ON b.source = r.source AND b.field = r.field AND b.cell = r."end"
              LEFT JOIN g x ON x.source = r.source AND x.field = r.field AND x.cell > r."start" AND x.cell < r."end"
                   AND (x.cell - x.size < r."start" OR r."end" - x.cell - x.size < {2 * PER_LEVEL} * x.size)) z
        JOIN g a ON a.source = z.source AND a.field = z.field AND a.cell = z."start"
        GROUP BY ALL)),
h AS (SELECT source, field, "end", min("start") AS f, max("start") AS t FROM run GROUP BY ALL HAVING min("start") < max("start")),
c AS (SELECT b.event_id, b."timestamp", h.field, (t.p - f.p) / ({c} * (h.t - h.f)) AS prev_mean,
             (b.p - t.p) / ({c} * (h."end" - h.t)) AS new_mean, CAST({c} * (h."end" - h.t) AS BIGINT) AS width
      FROM h JOIN e b ON b.source = h.source AND b.field = h.field AND b.cell = h."end"
      JOIN e f ON f.source = h.source AND f.field = h.field AND f.cell = h.f
      JOIN e t ON t.source = h.source AND t.field = h.field AND t.cell = h.t)
SELECT *, CASE WHEN prev_mean <> 0 THEN (new_mean - prev_mean) / abs(prev_mean) * 100 ELSE 0.0 END AS change_pct FROM c"""


QUERIES = {
    "adwin_drift": q_adwin_drift,
    "adwin_merged": q_adwin_merged,
    "adaptive_threshold": q_adaptive_threshold,
    "drift_adjacent": q_drift_adjacent,
    "explain_drift": q_explain_drift,
    "cluster_change": q_cluster_change,
    "cluster_learned": q_cluster_learned,
    "hst_scores": q_hst_scores,
}

ORACLE = {
    "adwin_merged": f"""SELECT event_id, "timestamp", field, {r6('prev_mean')} AS prev_mean, {r6('new_mean')} AS new_mean,
       {r6('change_pct')} AS change_pct, width FROM ({adwin_merged_body()})""",
    "adaptive_threshold": f"""WITH {EV}
SELECT event_id, {r6('price')} AS score,
       {r6(f'CASE WHEN count(price) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 10 THEN quantile_cont(price, 0.95) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) ELSE 0.5 END')} AS threshold,
       price > CASE WHEN count(price) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 10 THEN quantile_cont(price, 0.95) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) ELSE 0.5 END AS alert
FROM ev WHERE price IS NOT NULL""",
    "drift_adjacent": f"""SELECT event_id, "timestamp", {r6('prev_mean')} AS prev_mean, {r6('new_mean')} AS new_mean,
       {r6('change_pct')} AS change_pct, drift FROM ({drift_body()})""",
    "explain_drift": explain_drift_sql(),
    "cluster_change": f"""SELECT event_id, "timestamp", cluster, dominant, {r6('ratio')} AS ratio, prev_cluster
FROM ({cluster_body()})""",
    "cluster_learned": f"""SELECT event_id, "timestamp", cluster, dominant, {r6('ratio')} AS ratio, prev_cluster
FROM ({cluster_learned_body()})""",
    "hst_scores": f"SELECT event_id, {r6('score')} AS score FROM ({hst_body()})",
}
