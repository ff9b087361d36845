"""Quality rules: robust multivariate outliers.

Every document gets statistics of its whole text and a vector of five transformed
ones (log words, mean word length, and the square roots of the shares of symbols,
of repeated lines and of words in repeated three-word windows). Per language and
source the centre and the covariance of the vectors are estimated by minimum
covariance determinant: concentration steps that start at the medians and their
absolute deviations and go on with the three quarters of the rows that lie nearest
by the last estimate, then one reweighting step over all rows inside the 97.5 %
ellipsoid. Documents whose squared Mahalanobis distance exceeds the chi-square
limit, and those failing the base rules, are rejected.

The estimate is regularised: the squares of ``FLOORS``, the least spread that is
taken as real in each dimension, are added to the diagonal, so a group of equal texts
that fills most of a source (or a statistic that is zero in all clean texts) cannot
shrink the ellipsoid onto itself. Sources with fewer than ``min_rows`` documents
are estimated together per language, and languages with fewer together.

Scale: the text is read once; its statistics are a slim checkpointed table. The
medians and the limits of the nearest rows come from counts of fixed bins (so they
are mergeable, exact counts and equal in every rerun) and the estimates from sums, all
partially aggregated before the shuffle; estimates are one row per group, and
broadcast only while they are few. Repeated windows are found inside the row by
sorting packed hashes, in n log n time for a text of n words.

Cases: null and empty texts have no words and fail the base rules; null language or
source is a value of its own; repeated rows are judged alike; documents that fail
the base rules do not enter the estimates; an empty table gives an empty result;
input columns named like an output one are replaced. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, is_small, materialize, null_safe_join, packed, row_key, with_columns, words

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
VECTOR = ("log words", "mean word length", "symbols", "repeated lines", "repeated words")
FLOORS = (1.0, 0.8, 0.04, 0.12, 0.12)
NEAREST = 0.75
STEPS = 4
MIN_ROWS = 50
REWEIGHT = 12.832501994030027  # chi-square, 5 degrees of freedom, 0.975
LIMIT = 45.07614720640585  # the same, 1 - 1.4e-8 (about 5.5 standard deviations one-sided)
BINS_PER_UNIT = 64  # of a statistic, for its median
BINS_PER_OCTAVE = 32  # of a squared distance


def _array_stats(df: DataFrame, text: Column) -> DataFrame:
    """``__row`` and text to ``__row``, the counts of the text and ``__lines``."""
    blank = F.lit(BLANKS)
    df = df.withColumn("__w", words(text)).withColumn("__n", F.size("__w").cast("long"))
    solid = F.translate(text, BLANKS, "")
    clean = F.translate(text, SYMBOLS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, blank)) > 0)
    df = df.withColumns({
        "__word_chars": F.coalesce(F.length(solid), F.lit(0)).cast("long"),
        "__symbols": F.coalesce(F.length(text) - F.length(clean), F.lit(0)).cast("long"),
        "__ls": F.coalesce(lines, F.array().cast("array<string>")),
    })
    df = df.withColumns({"__lines": F.size("__ls").cast("long"),
                         "__dup_lines": (F.size("__ls") - F.size(F.array_distinct("__ls"))).cast("long")}).drop("__ls")
    return df


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``__repeat``: words covered by 3-word windows that occur twice or more.

    A window's hash is packed with its position in one long (the position in the low
    bits), so one primitive sort brings equal windows together. Neighbours equal in
    the packed hash bits are compared by the full hash of the window; should two
    different windows ever share the packed bits, that text takes the slow sort of
    (hash, position) pairs instead."""
    count = F.size("__w") - (WINDOW - 1)
    last = F.greatest(count, F.lit(1))
    hashes = F.when(count > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(
        *[F.element_at("__w", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__h", hashes).drop("__w")
    bits = F.length(F.bin(F.greatest(F.size("__h"), F.lit(1)).cast("long"))).cast("int")
    df = df.withColumn("__mask", (F.pow(F.lit(2.0), bits.cast("double")) - 1).cast("long"))
    low = F.bitwise_not(F.col("__mask"))
    df = df.withColumn("__sorted", F.sort_array(F.transform(
        "__h", lambda h, i: h.bitwiseAND(low).bitwiseOR(i.cast("long")))))
    df = df.withColumn("__last", F.size("__sorted") - 1)
    # positions in sorted order whose predecessor has the same packed bits
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.col("__last"), F.lit(1))), lambda k: F.coalesce(
        F.get("__sorted", k).bitwiseXOR(F.get("__sorted", k - 1)).bitwiseAND(low) == 0, F.lit(False)))
    df = df.withColumn("__same", F.when(F.col("__last") > 0, same).otherwise(F.array().cast("array<int>")))

    def place(k: Column) -> Column:
        return F.get("__sorted", k).bitwiseAND(F.col("__mask")).cast("int")

    mixed = F.exists("__same", lambda k: F.get("__h", place(k)) != F.get("__h", place(k - 1)))
    df = df.withColumn("__mixed", mixed)
    fast = F.flatten(F.transform("__same", lambda k: F.array(place(k - 1), place(k))))
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = F.transform(F.filter(F.transform(pairs, lambda p, k: F.struct(
        p["i"].alias("i"), p["h"].alias("h"), F.get(pairs, k - 1)["h"].alias("b"), F.get(pairs, k + 1)["h"].alias("a"))),
        lambda p: F.coalesce(p["h"] == p["b"], F.lit(False)) | F.coalesce(p["h"] == p["a"], F.lit(False))),
        lambda p: p["i"])
    df = df.withColumn("__at", F.array_sort(F.array_distinct(F.when(F.col("__mixed"), slow).otherwise(fast))))
    df = df.drop("__h", "__sorted", "__same", "__mask", "__last", "__mixed")
    # a union of windows of three: each adds its distance to the next, three at most
    gaps = F.transform("__at", lambda p, k: F.least(F.coalesce(F.get("__at", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.withColumn("__repeat", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)).drop("__at")


def text_stats(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``__n, __word_chars, __symbols, __lines, __dup_lines, __repeat``."""
    return _repeat_words(_array_stats(df, text))


def vector() -> list[Column]:
    n = F.greatest(F.col("__n"), F.lit(1)).cast("double")
    return [F.log1p(F.col("__n").cast("double")), F.col("__word_chars") / n,
            F.sqrt(F.col("__symbols") / F.greatest(F.col("__word_chars"), F.lit(1))),
            F.sqrt(F.col("__dup_lines") / F.greatest(F.col("__lines"), F.lit(1))), F.sqrt(F.col("__repeat") / n)]


_D = len(VECTOR)
_X = [f"__x{i}" for i in range(_D)]
_M = [f"__m{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]
_GROUP = ["__g1", "__g2"]


def _groups(df: DataFrame, min_rows: int) -> DataFrame:
    """Adds the estimate's group: language and source, the small sources of a language
    together, or the small languages together."""
    n1 = df.groupBy("__lang", "__src").agg(F.count(F.lit(1)).alias("__c"))
    small = F.col("__c") < min_rows
    by_lang = n1.filter(small).groupBy("__lang").agg(F.sum("__c").alias("__cl"))
    n1 = null_safe_join(n1, by_lang, ["__lang"], how="left")
    # a JSON array of the known values: null and "null" stay apart
    level = F.when(~small, F.to_json(F.array("__lang", "__src"))).when(
        F.col("__cl") >= min_rows, F.to_json(F.array("__lang"))).otherwise("[]")
    names = materialize(n1.select("__lang", "__src", level.alias("__g")))
    return null_safe_join(df, names, ["__lang", "__src"], small=is_small(names))


def _median(df: DataFrame, x: str) -> DataFrame:
    """Median of ``x`` per group to 1 / BINS_PER_UNIT, from counts per bin."""
    b = F.floor(F.col(x) * BINS_PER_UNIT)
    c = df.groupBy("__g", b.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy("__g").orderBy("__b")
    c = c.withColumn("__up", F.sum("__c").over(run)).withColumn("__all", F.sum("__c").over(Window.partitionBy("__g")))
    at = c.filter(F.col("__up") * 2 >= F.col("__all")).groupBy("__g").agg(F.min("__b").alias("__b"))
    return at.select("__g", ((F.col("__b") + 0.5) / BINS_PER_UNIT).alias(x))


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``__d2`` = (x - m)' S^-1 (x - m) by forward substitution with the Cholesky
    factor of the group's regularised covariance (columns ``__l<i><j>``)."""
    for i in range(_D):
        rest = F.col(_X[i]) - F.col(_M[i])
        for j in range(i):
            rest = rest - F.col(f"__l{i}{j}") * F.col(f"__z{j}")
        df = df.withColumn(f"__z{i}", rest / F.col(f"__l{i}{i}"))
    total = F.lit(0.0)
    for i in range(_D):
        total = total + F.col(f"__z{i}") * F.col(f"__z{i}")
    return df.withColumn("__d2", total).drop(*[f"__z{i}" for i in range(_D)])


def _cholesky(est: DataFrame) -> DataFrame:
    """Covariances ``__s<i><j>`` plus the floors to the lower factor ``__l<i><j>``."""
    for i in range(_D):
        for j in range(i + 1):
            v = F.col(f"__s{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            v = F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 * 1e-6))) if i == j else v / F.col(f"__l{j}{j}")
            est = est.withColumn(f"__l{i}{j}", v)
    return est.select("__g", *_M, *[f"__l{i}{j}" for i, j in _PAIRS])


def _moments(df: DataFrame) -> DataFrame:
    """Means and covariances per group. Sums are taken of the distances from fixed
    centres, so that squares of large values do not cancel."""
    aggs = [F.avg(x).alias(m) for x, m in zip(_X, _M, strict=True)]
    aggs += [F.covar_pop(_X[i], _X[j]).alias(f"__s{i}{j}") for i, j in _PAIRS]
    return df.groupBy("__g").agg(*aggs)


def _nearest(df: DataFrame) -> DataFrame:
    """The rows up to the distance bin with which a group's share NEAREST is reached."""
    b = F.floor(F.log2(F.col("__d2") + 1e-6) * BINS_PER_OCTAVE)
    df = df.withColumn("__b", b)
    c = df.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy("__g").orderBy("__b")
    c = c.withColumn("__up", F.sum("__c").over(run)).withColumn("__all", F.sum("__c").over(Window.partitionBy("__g")))
    at = c.filter(F.col("__up") >= F.col("__all") * NEAREST).groupBy("__g").agg(F.min("__b").alias("__edge"))
    return df.join(F.broadcast(at) if is_small(at) else at, "__g").filter("__b <= __edge")


def estimate(stats: DataFrame) -> DataFrame:
    """Centre and Cholesky factor per group of ``stats`` (``__g`` and the vector)."""
    start = None
    for x in _X:
        m = _median(stats, x)
        start = m if start is None else start.join(m, "__g")
    start = materialize(start.select("__g", *[F.col(x).alias(m) for x, m in zip(_X, _M, strict=True)]))
    small = is_small(start)
    join = lambda e: stats.join(F.broadcast(e) if small else e, "__g")
    spread = None
    dev = join(start)
    for i, x in enumerate(_X):
        s = _median(dev.withColumn(f"__v{i}", F.abs(F.col(x) - F.col(_M[i]))), f"__v{i}")
        spread = s if spread is None else spread.join(s, "__g")
    est = start.join(spread, "__g")
    est = est.withColumns({f"__s{i}{j}": F.pow(F.col(f"__v{i}") * 1.4826, 2) if i == j else F.lit(0.0) for i, j in _PAIRS})
    est = materialize(_cholesky(est))
    for _ in range(STEPS):
        est = materialize(_cholesky(_moments(_nearest(_distance(join(est))))))
    inside = _distance(join(est)).filter(F.col("__d2") <= REWEIGHT)
    last = _cholesky(_moments(inside))
    # a group with no row inside keeps its last estimate
    kept = est.join(last.select("__g"), "__g", "left_anti")
    return materialize(last.unionByName(kept))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", min_rows: int = MIN_ROWS, limit: float = LIMIT,
                  keep_columns: bool = True) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``distance2`` and ``kept``.

    ``keep_columns=False`` returns id and verdict columns only, from the slim table."""
    out = _judged(docs, id_col, text_col, lang_col, source_col, min_rows, limit)
    if not keep_columns:
        return out.select(F.col("__id").alias(id_col), *[F.col(c).alias(n) for n, c in OUTPUT.items()])
    joined = _with_rows(docs, out, id_col, text_col, lang_col, source_col)
    return joined.select(*with_columns(docs, {n: F.col(c) for n, c in OUTPUT.items()}))


OUTPUT = {"n_words": "__n", "word_chars": "__word_chars", "n_symbols": "__symbols", "n_dup_lines": "__dup_lines",
          "n_repeat_words": "__repeat", "base_failed": "__failed", "distance2": "__d2", "kept": "__kept"}


def _judged(docs, id_col, text_col, lang_col, source_col, min_rows, limit) -> DataFrame:
    """Statistics and verdict per row, without the text."""
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    k1, k2 = row_key(ident, text)
    own = docs.select(ident.alias("__id"), k1.alias("__k1"), k2.alias("__k2"), text.alias("__text"),
                      F.col(f"`{lang_col}`").cast("string").alias("__lang"),
                      F.col(f"`{source_col}`").cast("string").alias("__src"))
    slim = materialize(text_stats(own, F.col("__text")).drop("__text"))
    failed = (F.col("__n") < MIN_WORDS) | (F.col("__repeat") * 100 > F.col("__n") * MAX_REPEAT_PCT)
    slim = slim.select("*", failed.alias("__failed"), *[v.alias(x) for v, x in zip(vector(), _X, strict=True)])
    grouped = _groups(slim.filter("NOT __failed"), min_rows)
    grouped = materialize(grouped)
    est = estimate(grouped.select("__g", *_X))
    judged = _distance(grouped.join(F.broadcast(est) if is_small(est) else est, "__g", "left"))
    judged = judged.select("__id", "__k1", "__k2", "__lang", "__src", "__n", "__word_chars", "__symbols",
                           "__dup_lines", "__repeat", "__failed", "__d2")
    out = judged.unionByName(slim.filter("__failed").select(*[c for c in judged.columns if c != "__d2"]),
                             allowMissingColumns=True)
    fine = ~F.col("__failed") & (F.coalesce(F.col("__d2"), F.lit(0.0)) <= limit)
    return out.withColumn("__kept", fine)


def _with_rows(docs, judged, id_col, text_col, lang_col, source_col) -> DataFrame:
    """``__row`` with the columns of its verdict. Equal keys have equal statistics; the
    verdict may differ by language and source."""
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    k1, k2 = row_key(ident, text)
    keyed = docs.select(packed(docs), k1.alias("__k1"), k2.alias("__k2"),
                        F.col(f"`{lang_col}`").cast("string").alias("__lang"),
                        F.col(f"`{source_col}`").cast("string").alias("__src"))
    verdicts = judged.dropDuplicates(["__k1", "__k2", "__lang", "__src"]).drop("__id")
    return null_safe_join(keyed, verdicts, ["__k1", "__k2", "__lang", "__src"])


def reject(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source", min_rows: int = MIN_ROWS, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    judged = _judged(docs, id_col, text_col, lang_col, source_col, min_rows, limit).filter("__kept")
    return _with_rows(docs, judged, id_col, text_col, lang_col, source_col).select("__row.*")
