"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight (a source is filled at most ``cap`` times; what
that leaves over goes to the others by weight). With r = target / source size every
document of the source is taken floor(r) times for certain. The rest of the target
is a Pareto order sample: a document has a uniform number u from a hash of its id
and text, the inclusion odds p / (1 - p) of its source's remaining share p (times
its own ``odds_col`` if given, which makes the inclusion unequal inside a source),
and is ranked by its random odds divided by its inclusion odds, u / (1 - u) /
odds. The sample's size is fixed in words: the documents of lowest rank whose
words fit the rest, and up to FITS more that fill the gap which is left: the largest
that fit, and last the one whose size comes nearest, if it narrows the gap. Reruns draw
the same documents.

Scale: the text is read once for a slim table (source, size, hash, rank) that is
checkpointed, and once for the result. Sizes are summed per source and the cut is
found by cumulative sums over 4,096 rank buckets a source, then over 4,096 parts of
the bucket that holds the cut, and only then row by row, so no task sorts a source.
A source's plan is one row; the plan is broadcast only while it has few rows.

Cases: null source is a source of its own (last in the weight order); null or empty
text has size 0 and is never drawn beyond the whole copies; rows equal in id, text
and source share their random number and are taken or left together; an empty
table gives an empty result; input columns named like an output one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RUN, is_small, materialize, null_safe_join, packed, with_columns

PARTS = 4096  # rank buckets a source on each of two levels
FITS = 3  # documents a source that fill the gap behind the last rank that fits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column) -> tuple[Column, Column]:
    """A number in [0, 1) with 52 random bits, and 48 more bits against ties."""
    digest = F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    first = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    return first, F.conv(F.substring(digest, 14, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float, total: float | None = None) -> DataFrame:
    """``(__src, __size)`` per source to ``(__src, __size, __target)``.

    The reshared targets are min(cap * size, level * weight) with the level at which
    they add up to the total; sources are capped in the order of cap * size / weight,
    so running sums over that order give the level without iteration."""
    rank = F.row_number().over(Window.orderBy(F.col("__src").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("__w", w).withColumn("__cap", F.lit(float(cap)) * F.col("__size"))
    everything = Window.partitionBy(F.lit(0))
    t = t.withColumn("__total", F.lit(float(total)) if total is not None else
                     F.sum(F.col("__size").cast("double")).over(everything))
    t = t.withColumn("__all_w", F.sum("__w").over(everything))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("__cap") / F.col("__w"), F.col("__src").asc_nulls_last())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    weight_left = F.col("__all_w") - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    t = t.withColumn("__level", (F.col("__total") - used) / weight_left)
    # the first source whose cap lies above its level ends the capped ones
    level = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"),
                  F.col("__level")))).over(everything)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap")))
    return t.select("__src", "__size", target.alias("__target"))


def _cut_level(rows: DataFrame, plan: DataFrame, small: bool, bucket: str, keys: list[str]) -> DataFrame:
    """Narrow each source's cut to one bucket: adds the words before it to ``__before``."""
    sums = rows.groupBy("__src", bucket).agg(F.sum("__n").alias("__bn"))
    w = Window.partitionBy("__src").orderBy(bucket)
    run = null_safe_join(sums, plan, ["__src"], small=small)
    run = run.withColumn("__upto", F.col("__before") + F.sum("__bn").over(w))
    crossed = run.filter((F.col("__upto") > F.col("__rest")) & (F.col("__upto") - F.col("__bn") <= F.col("__rest")))
    return crossed.groupBy("__src").agg(F.min_by(F.struct(
        F.col(bucket), (F.col("__upto") - F.col("__bn")).alias("__b"), "__rest", *keys), F.col(bucket)).alias("__x")).select(
        "__src", "__x.__rest", F.col("__x.__b").alias("__before"), f"__x.{bucket}", *[f"__x.{k}" for k in keys])


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: int = 3, total: float | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        odds_col: str | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of the source) and
    ``copies`` (times the mix takes the document, 0 to ``cap``). ``weights`` are dealt
    to the sources in code point order, again from the first when they run out;
    ``total`` is the words to share, by default all of them."""
    rows = _planned(docs, weights, cap, total, id_col, text_col, source_col, odds_col)
    return rows.select(*with_columns(docs, {"size": F.col("__n"), "source_size": F.col("__size"),
                                            "target": F.col("__target"), "copies": F.col("__copies")}))


def take(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: int = 3, total: float | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         odds_col: str | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    rows = _planned(docs, weights, cap, total, id_col, text_col, source_col, odds_col)
    times = F.array_repeat(F.lit(0), F.col("__copies").cast("int"))
    return rows.select("__row", F.explode(times).alias("__copy")).select("__row.*")


def _planned(docs, weights, cap, total, id_col, text_col, source_col, odds_col) -> DataFrame:
    """``__row`` with ``__n``, ``__size``, ``__target`` and ``__copies``."""
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    u, tie = draw(ident, text)
    tilt = F.lit(1.0) if odds_col is None else F.col(f"`{odds_col}`").cast("double")
    own = [F.col(f"`{source_col}`").cast("string").alias("__src"), word_count(text).alias("__n"), u.alias("__u"),
           tie.alias("__t"), tilt.alias("__odds")]
    slim = materialize(docs.select(*own))
    totals = slim.groupBy("__src").agg(F.sum("__n").alias("__size"))
    t = source_targets(totals, weights, cap, total)
    ratio = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)
    t = t.withColumn("__whole", F.least(F.floor(ratio), F.lit(cap)).cast("long"))
    t = t.withColumn("__rest", F.greatest(F.col("__target") - F.col("__whole") * F.col("__size"), F.lit(0.0)))
    t = materialize(t.withColumn("__p", F.when(F.col("__size") > 0, F.col("__rest") / F.col("__size")).otherwise(0.0)))
    small = is_small(t)

    def ranked(df: DataFrame) -> DataFrame:
        p = null_safe_join(df, t.select("__src", F.col("__p").alias("__share")), ["__src"], small=small)
        odds = F.col("__share") / (1 - F.col("__share")) * F.col("__odds")
        q = F.when((F.col("__share") > 0) & (F.col("__share") < 1), F.col("__u") / (1 - F.col("__u")) / odds)
        return p.withColumn("__q", q)

    live = ranked(slim).filter(F.col("__q").isNotNull() & (F.col("__n") > 0))
    place = F.col("__q") / (1 + F.col("__q")) * PARTS
    live = live.withColumn("__b1", F.least(F.floor(place), F.lit(PARTS - 1)).cast("int"))
    live = live.withColumn("__b2", F.least(F.floor((place - F.floor(place)) * PARTS), F.lit(PARTS - 1)).cast("int"))
    start = t.filter("__rest > 0").select("__src", "__rest", F.lit(0.0).alias("__before"))
    cut1 = materialize(_cut_level(live, start, small, "__b1", []))
    in1 = null_safe_join(live, cut1.select("__src", F.col("__b1").alias("__c1")), ["__src"], small=small)
    in1 = in1.filter("__b1 = __c1")
    cut2 = materialize(_cut_level(in1, cut1, small, "__b2", ["__b1"]))
    in2 = null_safe_join(live, cut2.select("__src", F.col("__b1").alias("__c1"), F.col("__b2").alias("__c2"),
                                           "__before", "__rest"), ["__src"], small=small)
    in2 = in2.filter("__b1 = __c1 AND __b2 = __c2")
    w = Window.partitionBy("__src").orderBy("__q", "__t")  # RANGE frame: equal rows enter together
    in2 = in2.withColumn("__cum", F.col("__before") + F.sum("__n").over(w)).filter("__cum <= __rest")
    last = in2.groupBy("__src").agg(F.max(F.struct("__q", "__t")).alias("__last"), F.max("__cum").alias("__cum"))
    # a source without a row in its last part ends at that part's lower edge
    edge = null_safe_join(cut2, last, ["__src"], how="left", small=small)
    v = (F.col("__b1") + F.col("__b2") / F.lit(float(PARTS))) / F.lit(float(PARTS))
    edge = edge.select("__src", F.coalesce("__last.__q", v / (1 - v)).alias("__eq"),
                       F.coalesce("__last.__t", F.lit(-1).cast("long")).alias("__et"),
                       (F.col("__rest") - F.coalesce("__cum", "__before")).alias("__gap"))
    edge = materialize(edge.withColumn("__f", F.array().cast("array<struct<q:double,t:bigint>>")))
    me = F.struct(F.col("__q").alias("q"), F.col("__t").alias("t"))
    behind = (F.col("__q") > F.col("__eq")) | ((F.col("__q") == F.col("__eq")) & (F.col("__t") > F.col("__et")))
    for k in range(FITS):
        rest = null_safe_join(live, edge, ["__src"], small=small).filter(behind & ~F.array_contains("__f", me))
        miss = F.abs(F.col("__gap") - F.col("__n"))
        fits = miss < F.col("__gap") if k == FITS - 1 else F.col("__n") <= F.col("__gap")
        pick = rest.filter(fits).groupBy("__src").agg(F.min(F.struct(
            miss, F.col("__q").alias("q"), F.col("__t").alias("t"), F.col("__n").alias("n"))).alias("__x"))
        edge = null_safe_join(edge, pick, ["__src"], how="left", small=small)
        hit = F.col("__x").isNotNull()
        edge = materialize(edge.select(
            "__src", "__eq", "__et", F.when(hit, F.col("__gap") - F.col("__x.n")).otherwise(F.col("__gap")).alias("__gap"),
            F.when(hit, F.array_append("__f", F.struct("__x.q", "__x.t"))).otherwise(F.col("__f")).alias("__f")))
    plan = null_safe_join(t, edge, ["__src"], how="left", small=small)
    plan = materialize(plan.select("__src", "__size", "__target", "__whole", "__eq", "__et", "__p", "__f"))

    rows = docs.select(packed(docs), *own)
    rows = null_safe_join(rows, plan, ["__src"], small=small)
    odds = F.col("__p") / (1 - F.col("__p")) * F.col("__odds")
    q = F.when((F.col("__p") > 0) & (F.col("__p") < 1) & (F.col("__n") > 0), F.col("__u") / (1 - F.col("__u")) / odds)
    rows = rows.withColumn("__q", q)
    # a source without a cut has room for all its rows beyond the whole copies
    under = (F.col("__q") < F.col("__eq")) | ((F.col("__q") == F.col("__eq")) & (F.col("__t") <= F.col("__et")))
    fits = F.array_contains("__f", me)
    chosen = F.when(F.col("__q").isNull(), False).when(F.col("__eq").isNull(), True).otherwise(
        under | F.coalesce(fits, F.lit(False)))
    copies = F.least(F.col("__whole") + chosen.cast("long"), F.lit(cap).cast("long"))
    return rows.withColumn("__copies", copies)
