"""Query API over the event / pattern / feedback tables, as DataFrame functions.

Filters are plain column predicates, so Catalyst pushes them into the Parquet
scan; a ``start``/``end`` range also becomes an ``event_date`` predicate when the
table is day-partitioned (partition pruning). ``ORDER BY ... LIMIT n`` plans as
TakeOrderedAndProject (per-task top-n, no full sort).
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detectors.explain import explain
from ..functions.ids import stable_id
from ..functions.timefmt import iso_text

MAX_LIMIT = 1000
DEFAULT_LIMIT = 100


class NotFound(LookupError):
    """No row with the requested id."""


def _check_limit(limit: int) -> int:
    if not isinstance(limit, int) or limit < 1 or limit > MAX_LIMIT:
        raise ValueError(f"limit must be an integer in 1..{MAX_LIMIT}")
    return limit


def _ts(v):
    if v is None or v == "":
        return None
    if isinstance(v, datetime):
        return F.lit(v).cast("timestamp")
    return F.to_timestamp(F.lit(str(v)))


def query_events(
    df: DataFrame,
    source: str | None = None,
    type: str | None = None,
    start=None,
    end=None,
    pattern_id: str | None = None,
    limit: int = DEFAULT_LIMIT,
    id_col: str | None = None,
) -> DataFrame:
    """Conjunctive filter (inclusive time range; empty values ignored), newest first, top ``limit``."""
    _check_limit(limit)
    conds = []
    if source:
        conds.append(F.col("source") == source)
    if type:
        conds.append(F.col("type") == type)
    lo, hi = _ts(start), _ts(end)
    if lo is not None:
        conds.append(F.col("timestamp") >= lo)
    if hi is not None:
        conds.append(F.col("timestamp") <= hi)
    if "event_date" in df.columns:
        if lo is not None:
            conds.append(F.col("event_date") >= F.to_date(lo))
        if hi is not None:
            conds.append(F.col("event_date") <= F.to_date(hi))
    if pattern_id:
        conds.append(F.col("pattern_id") == pattern_id)
    out = df.filter(reduce(lambda a, b: a & b, conds)) if conds else df
    idc = id_col or ("pattern_id" if "pattern_id" in df.columns else "event_id")
    return out.orderBy(F.col("timestamp").desc(), F.col(idc).desc()).limit(limit)


def decode(df: DataFrame, json_cols=("payload", "meta", "details"), arrays=("contributors",)) -> DataFrame:
    """JSON text columns -> VARIANT (bad JSON -> {} / []), timestamps -> ISO text."""
    out = df
    for c in json_cols:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.expr(f"try_parse_json(`{c}`)"), F.parse_json(F.lit("{}"))))
    for c in arrays:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.expr(f"try_parse_json(`{c}`)"), F.parse_json(F.lit("[]"))))
    for c in ("timestamp", "ingest_time", "processing_time"):
        if c in out.columns:
            out = out.withColumn(c, iso_text(F.col(c)))
    return out


def get_events(clean: DataFrame, source=None, event_type=None, start_time=None, end_time=None,
               limit: int = DEFAULT_LIMIT, decoded: bool = False) -> DataFrame:
    """Events newest first; ``decoded`` turns JSON text into values and times into ISO text."""
    out = query_events(clean, source=source, type=event_type, start=start_time, end=end_time, limit=limit)
    return decode(out) if decoded else out


def get_patterns(patterns: DataFrame, source=None, pattern_type=None, start_time=None, end_time=None,
                 limit: int = DEFAULT_LIMIT, lang: str = "zh", decoded: bool = False) -> DataFrame:
    """Patterns newest first with their explanation text; ``decoded`` as in ``get_events``."""
    out = explain(query_events(patterns, source=source, type=pattern_type, start=start_time, end=end_time,
                               limit=limit), lang=lang)
    return decode(out) if decoded else out


def get_pattern(patterns: DataFrame, pattern_id: str, lang: str = "zh", check: bool = False) -> DataFrame:
    """One pattern by id (0 or 1 rows). ``check=True`` raises NotFound when absent
    (runs a 1-row job)."""
    out = explain(query_events(patterns, pattern_id=pattern_id, limit=1), lang=lang)
    if check and not out.take(1):
        raise NotFound("Pattern not found")
    return out


def get_sources(clean: DataFrame) -> DataFrame:
    return clean.select(F.col("source").alias("name")).distinct()


def get_pattern_types(patterns: DataFrame) -> DataFrame:
    return patterns.select(F.col("type").alias("name")).distinct()


def accept_feedback(feedback: DataFrame, patterns: DataFrame, id_cols=("pattern_id", "user_id", "timestamp")):
    """Split submitted feedback into (accepted, rejected).

    Accepted: rating in -1..1 and the pattern exists (left-semi join on
    pattern_id). Rejected rows carry ``reason`` = ``invalid_rating`` or
    ``pattern_not_found``. Pattern ids are de-duplicated before the joins, so
    the semi / anti joins never multiply rows. The accepted rows get a feedback_id
    (md5 of ``id_cols``) and are in the feedback-table layout."""
    ids = patterns.select("pattern_id").distinct()
    ok_rating = F.col("rating").isNotNull() & F.col("rating").between(-1, 1)
    valid = feedback.filter(ok_rating)
    accepted = valid.join(ids, "pattern_id", "left_semi")
    missing = valid.join(ids, "pattern_id", "left_anti").withColumn("reason", F.lit("pattern_not_found"))
    bad = feedback.filter(~ok_rating | F.col("rating").isNull()).withColumn("reason", F.lit("invalid_rating"))
    accepted = accepted.select(
        stable_id(*id_cols).alias("feedback_id"), "pattern_id", "timestamp", F.col("user_id").cast("string"),
        F.col("rating").cast("tinyint").alias("rating"), F.col("comment").cast("string"))
    return accepted, bad.unionByName(missing)


def overview(events: DataFrame, patterns: DataFrame, approx: bool = False) -> DataFrame:
    """Dashboard numbers: events, patterns, distinct sources, distinct pattern types."""
    cd = F.approx_count_distinct if approx else F.count_distinct
    e = events.agg(F.count(F.lit(1)).alias("events"), cd("source").alias("sources"))
    p = patterns.agg(F.count(F.lit(1)).alias("patterns"), cd("type").alias("pattern_types"))
    # both sides are single-row aggregates; the join key is a constant
    return e.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")


# ---- fixed values: list-view placeholder text ----
NO_EXPLANATION = "无说明"
# ---- end of fixed values ----


def short_view(patterns: DataFrame, width: int = 50) -> DataFrame:
    """List-view columns: 8-char id + '...', confidence as whole percent
    (default 0.5 when details lack it), explanation cut to ``width`` chars + '...'."""
    conf = F.coalesce(F.get_json_object("details", "$.confidence").try_cast("double"), F.lit(0.5))
    pct = F.concat(F.round(conf * 100, 0).cast("long").cast("string"), F.lit("%"))
    text = F.coalesce(F.col("explanation"), F.lit(NO_EXPLANATION)) if "explanation" in patterns.columns else F.lit(
        NO_EXPLANATION)
    short = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
    return patterns.select("*", F.concat(F.substring("pattern_id", 1, 8), F.lit("...")).alias("short_id"),
                           pct.alias("confidence_pct"), short.alias("short_explanation"))
