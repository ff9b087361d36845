"""Plain-text explanation of pattern rows (drift / anomaly / cluster change / other).

Built from JVM-side string functions: details (JSON text) are read as a
``map<string,string>`` (key order kept), contributors as an array of
{field, score}; top-3 contributors by score (stable), the field with the largest
absolute ``*_change_pct`` (strictly greater, so 0 never wins), numbers with two
decimals (rounded on the exact binary value, half to even).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import display_text

# ---- fixed values: explanation templates (must equal the reference's text) ----
TEMPLATES = {
    "zh": {
        "unknown": "在 {time} 检测到未知模式类型 {type}，来源于 {source}。",
        "drift": "在 {time} 检测到概念漂移，来源于 {source}。",
        "drift_change": " {field} 从 {prev} {direction}到 {new}，变化率 {pct}%。",
        "up": "增加",
        "down": "减少",
        "anomaly": "在 {time} 检测到异常，来源于 {source}。",
        "anomaly_score": " 异常分数 {score}，超过阈值 {threshold}。",
        "cluster_change": "在 {time} 检测到聚类变化，来源于 {source}。",
        "cluster_move": " 聚类从 {prev} 变化到 {new}。",
        "contributors": " 主要贡献因子: {contributors}。",
        "confidence": " 置信度: {confidence}。",
    },
    "en": {
        "unknown": "Unknown pattern type {type} detected at {time} from {source}.",
        "drift": "Concept drift detected at {time} from {source}.",
        "drift_change": " {field} {direction} from {prev} to {new}, change {pct}%.",
        "up": "increased",
        "down": "decreased",
        "anomaly": "Anomaly detected at {time} from {source}.",
        "anomaly_score": " Anomaly score {score} exceeds threshold {threshold}.",
        "cluster_change": "Cluster change detected at {time} from {source}.",
        "cluster_move": " Cluster moved from {prev} to {new}.",
        "contributors": " Main contributors: {contributors}.",
        "confidence": " Confidence: {confidence}.",
    },
}
# ---- end of fixed values ----

_CONTRIB = "array<struct<field:string,score:double>>"


def fmt2(x: Column) -> Column:
    """``f"{x:.2f}"``: two decimals, rounded on the exact binary value (ties to even).

    The shortest decimal form ``d`` of the double rounds the same way unless ``d``
    is itself a tie (``k/1000`` ending in 5). Then the side of the tie the exact
    binary value lies on is found with an error-free product (Veltkamp split):
    x * 1000 = p + err exactly, and sign((p - k) + err) is exact."""
    a = F.abs(x)
    d = a.try_cast("decimal(38,18)")
    k = d * 1000
    tie = (k == F.floor(k)) & (F.floor(k) % 10 == 5)
    p = a * F.lit(1000.0)
    t1 = a * F.lit(134217729.0)
    hi = t1 - (t1 - a)
    lo = a - hi
    err = (hi * F.lit(1000.0) - p) + lo * F.lit(1000.0)
    side = (p - k.cast("double")) + err
    down = F.floor(k / 10) / 100
    up = (F.floor(k / 10) + 1) / 100
    even = F.bround(d, 2)
    r = F.when(~tie, even).when(side > 0, up).when(side < 0, down).otherwise(even)
    text = r.cast("decimal(38,2)").cast("string")
    neg = (x < 0) | ((x == 0) & (F.try_divide(F.lit(1.0), x) < 0))
    signed = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), text)
    return F.when(x.isNull(), F.lit(None)).when(a < 1e15, signed).otherwise(F.format_string("%.2f", x))


def _fill(template: str, **parts: Column) -> Column:
    """Template with ``{name}`` slots -> concat of literal pieces and columns."""
    out: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(F.lit(rest))
            break
        if i:
            out.append(F.lit(rest[:i]))
        j = rest.index("}", i)
        out.append(parts[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*out)


def contributors_text(contributors: Column, top: int = 3) -> Column:
    """``field (0.70), field2 (0.30)`` from JSON text; missing score = 0, missing field = ''."""
    arr = F.coalesce(F.from_json(contributors, _CONTRIB), F.array().cast(_CONTRIB))
    keyed = F.transform(arr, lambda c, i: F.struct(
        (-F.coalesce(c["score"], F.lit(0.0))).alias("neg"), i.alias("pos"),
        F.coalesce(c["field"], F.lit("")).alias("field"), F.coalesce(c["score"], F.lit(0.0)).alias("score")))
    best = F.slice(F.array_sort(keyed), 1, top)
    parts = F.transform(best, lambda c: F.concat(c["field"], F.lit(" ("), fmt2(c["score"]), F.lit(")")))
    return F.array_join(parts, ", ")


def explain(df: DataFrame, lang: str = "zh", out: str = "explanation") -> DataFrame:
    """Add the explanation column (and default empty details / contributors)."""
    t = TEMPLATES[lang]
    details = F.coalesce(F.col("details"), F.lit("{}"))
    contributors = F.coalesce(F.col("contributors"), F.lit("[]"))
    d = F.coalesce(F.from_json(details, "map<string,string>"), F.create_map().cast("map<string,string>"))
    def num(k: str) -> Column:
        return F.element_at(d, F.lit(k)).try_cast("double")

    time = F.coalesce(display_text(F.col("timestamp")), F.col("timestamp").cast("string"))
    src = F.coalesce(F.col("source").cast("string"), F.lit("None"))
    ctext = contributors_text(contributors)
    ctext_part = F.when(F.length(ctext) > 0, _fill(t["contributors"], contributors=ctext)).otherwise(F.lit(""))
    conf = F.coalesce(num("confidence"), F.lit(0.0))
    conf_part = _fill(t["confidence"], confidence=fmt2(conf))

    # drift: field with the largest |<field>_change_pct| (strictly greater than the best so far)
    pct_keys = F.filter(F.map_keys(d), lambda k: k.endswith("_change_pct") & F.element_at(d, k).try_cast("double").isNotNull())
    best = F.aggregate(
        pct_keys,
        F.struct(F.lit(None).cast("string").alias("f"), F.lit(0.0).alias("v")),
        lambda acc, k: F.when(F.abs(F.element_at(d, k).try_cast("double")) > F.abs(acc["v"]),
                              F.struct(F.regexp_replace(k, "_change_pct$", "").alias("f"),
                                       F.element_at(d, k).try_cast("double").alias("v"))).otherwise(acc),
    )
    prev = F.element_at(d, F.concat(best["f"], F.lit("_prev_mean"))).try_cast("double")
    new = F.element_at(d, F.concat(best["f"], F.lit("_new_mean"))).try_cast("double")
    change = F.when(
        best["f"].isNotNull() & (best["v"] != 0) & prev.isNotNull() & new.isNotNull(),
        _fill(t["drift_change"], field=best["f"], prev=fmt2(prev),
              direction=F.when(best["v"] > 0, F.lit(t["up"])).otherwise(F.lit(t["down"])),
              new=fmt2(new), pct=fmt2(F.abs(best["v"]))),
    ).otherwise(F.lit(""))
    drift = F.concat(_fill(t["drift"], time=time, source=src), change, ctext_part, conf_part)

    score = F.coalesce(num("score"), F.lit(0.0))
    thr = F.coalesce(num("threshold"), F.lit(0.0))
    anomaly = F.concat(_fill(t["anomaly"], time=time, source=src),
                       _fill(t["anomaly_score"], score=fmt2(score), threshold=fmt2(thr)), ctext_part, conf_part)

    pc, nc = F.element_at(d, F.lit("prev_cluster")), F.element_at(d, F.lit("new_cluster"))
    move = F.when(pc.isNotNull() & nc.isNotNull(), _fill(t["cluster_move"], prev=pc, new=nc)).otherwise(F.lit(""))
    cluster = F.concat(_fill(t["cluster_change"], time=time, source=src), move, ctext_part, conf_part)

    unknown = _fill(t["unknown"], time=time, type=F.coalesce(F.col("type"), F.lit("None")), source=src)
    text = (F.when(F.col("type") == "drift", drift).when(F.col("type") == "anomaly", anomaly)
            .when(F.col("type") == "cluster_change", cluster).otherwise(unknown))
    return df.withColumn("details", details).withColumn("contributors", contributors).withColumn(out, text)
