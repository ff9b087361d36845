"""Documented tier-2 operators: text cleaning and keywords, outlier filters,
population-stability drift, pattern reports, feedback statistics, table
snapshot ids, business-day calendar, frequent itemsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..plans.rolling import null_safe_join

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def text_clean(col: str = "text"):
    """Lower-case, every run of non letter / digit characters -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.col(col)), TOKEN_SPLIT, " "))


def keyword_topk(docs: DataFrame, k: int = 20, by: Sequence[str] = ("lang",), text: str = "text",
                 min_len: int = 1) -> DataFrame:
    """Top-``k`` tokens (count desc, token asc) per group over whole texts.

    Tokens are counted with a ``groupBy`` (partial aggregation, so a hot group
    or token is one partial row per task); the rank runs on the counts table
    (one row per distinct token and group)."""
    tokens = docs.select(*by, F.explode(F.split(text_clean(text), " ")).alias("token")).filter(
        F.length("token") >= min_len)
    counts = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("token"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def zscore_filter(df: DataFrame, col: str, key: Sequence[str], z: float = 3.0) -> DataFrame:
    """Keep rows with |x - mean| <= z * population std of their key (std 0 keeps all)."""
    st = df.groupBy(*key).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    j = null_safe_join(df, st, list(key))
    keep = (F.col("_s") == 0) | (F.abs(F.col(col) - F.col("_m")) <= z * F.col("_s"))
    return j.filter(keep).drop("_m", "_s")


def iqr_filter(df: DataFrame, col: str, key: Sequence[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """Box-plot fences: keep Q1 - k*IQR <= x <= Q3 + k*IQR per key."""
    if exact:
        st = exact_quantiles(df, key, col, [0.25, 0.75])
    else:
        st = df.groupBy(*key).agg(F.percentile_approx(col, [0.25, 0.75], 10000).alias("_q"))
    j = null_safe_join(df, st, list(key))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    return j.filter((F.col(col) >= F.col("_q")[0] - k * iqr) & (F.col(col) <= F.col("_q")[1] + k * iqr)).drop("_q")


def psi(base: DataFrame, current: DataFrame, col: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index of ``col``: exact decile edges of the base period,
    shares per bin in both periods, sum((a - b) * ln(a / b)) with empty bins floored at
    ``eps``. Rows without a value count in neither period; NaN falls in the last bin."""
    base, current = base.filter(F.col(col).isNotNull()), current.filter(F.col(col).isNotNull())
    found = exact_quantiles(base, [], col, [i / bins for i in range(1, bins)]).first()
    edges = sorted(set(found["_q"] or [])) if found else []

    def binned(df, name):
        b = F.lit(0)
        for e in edges:
            b = b + F.when(F.col(col) >= F.lit(e), 1).otherwise(0)
        counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))  # at most ``bins`` rows
        return counts.select("bin", (F.col("_c") / F.sum("_c").over(Window.partitionBy(F.lit(0)))).alias(name))

    j = binned(base, "a").join(binned(current, "b"), "bin", "full_outer").fillna(0.0, ["a", "b"])
    a, b = F.greatest(F.col("a"), F.lit(eps)), F.greatest(F.col("b"), F.lit(eps))
    return j.agg(F.sum((a - b) * F.log(a / b)).alias("psi"), F.count(F.lit(1)).alias("bins"))


def pattern_report(patterns: DataFrame) -> DataFrame:
    """Per (type, source): first / last time, seconds between them, count (support), mean
    confidence."""
    conf = F.get_json_object("details", "$.confidence").try_cast("double")
    return patterns.groupBy("type", "source").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("lifetime_sec"),
        F.count(F.lit(1)).alias("support"), F.avg(conf).alias("mean_confidence"))


def feedback_stats(feedback: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per pattern type: rated patterns, ratings, mean rating (feedback joined to patterns)."""
    per = feedback.groupBy("pattern_id").agg(F.avg("rating").alias("_r"), F.count(F.lit(1)).alias("_n"))
    j = per.join(patterns.select("pattern_id", "type").distinct(), "pattern_id")
    return j.groupBy("type").agg(F.count(F.lit(1)).alias("patterns"), F.sum("_n").alias("ratings"),
                                 (F.sum(F.col("_r") * F.col("_n")) / F.sum("_n")).alias("mean_rating"))


def feedback_by_pattern(feedback: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per rated pattern: its type, ratings, mean rating, and ratings by label."""
    per = feedback.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("ratings"), F.avg("rating").alias("mean_rating"),
        F.count_if(F.col("rating") > 0).alias("positive"), F.count_if(F.col("rating") < 0).alias("negative"))
    return per.join(patterns.select("pattern_id", "type").distinct(), "pattern_id")


def snapshot_id(df: DataFrame) -> DataFrame:
    """Order-free content id of a table: row count and the sum of 60-bit row hashes. A
    row's hash is md5 over its values as text, in an engine-neutral form: numbers with a
    fraction to six places, times as microseconds, null as ``\\N``."""
    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = c.cast("decimal(38,6)")
        elif kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        return F.coalesce(c.cast("string"), F.lit("\\N"))

    digest = F.md5(F.concat_ws("|", *[text(n, k) for n, k in df.dtypes]))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("hash_sum"))


def business_days(df: DataFrame, col: str) -> DataFrame:
    """Monday-to-Friday dates spanning the data's [min, max] date range of ``col``."""
    return trading_days(df, col)


def align_tz(df: DataFrame, col: str, zone: str = "UTC") -> DataFrame:
    """``col`` (an instant) as wall time in ``zone``, without a zone of its own."""
    utc = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.col(col).cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
    return df.withColumn(col, utc)


def trading_days(df: DataFrame, col: str, zone: str | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """Trading days (column ``day``): Monday to Friday within the [min, max] day of ``col``,
    without the days in the first column of ``holidays``. With ``zone``, ``col`` is an
    instant and days are those of that zone's wall time. Null times and null holidays count for nothing."""
    rows = (align_tz(df, col, zone) if zone else df).select(F.to_date(col).alias("_d"))
    span = rows.agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")).filter(F.col("lo").isNotNull())
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).filter(~F.dayofweek("day").isin(1, 7))
    if holidays is None:
        return days
    closed = holidays.select(F.to_date(holidays.columns[0]).alias("day")).distinct()
    return days.join(closed, "day", "left_anti")


def per_trading_day(df: DataFrame, col: str, zone: str = "UTC", holidays: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` on each trading day of ``zone``; days without a row have 0."""
    days = trading_days(df, col, zone, holidays)
    counts = align_tz(df, col, zone).groupBy(F.to_date(col).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def frequent_itemsets(baskets: DataFrame, items: str = "items", min_support: float = 0.01,
                      min_confidence: float = 0.5):
    """Frequent itemsets and rules (parallel FP-growth, Spark ML)."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    return model.freqItemsets, model.associationRules
