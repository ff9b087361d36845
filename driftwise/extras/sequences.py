"""Event sequences: last known values of several sources side by side, and frequent ordered
patterns of event types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rolling import materialize, null_safe_join, rows_index, running_rows


def fuse_asof(frames: Mapping[str, DataFrame], value: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every event of every source with the last value of each source up to it, per key.

    Events are put into one sequence (``order`` decides between sources too; the source's
    name comes last) and values carried forward: running last values of a block, and the
    last ones of the key's earlier blocks, so a hot key is split and no pair of events is
    formed. Returns key, order, ``source_name`` and a column per source; null until a source
    has a value (null values are skipped)."""
    key, order = list(key), list(order)
    parts = [df.select(*[F.col(c) for c in [*key, *order]], F.lit(n).alias("source_name"), F.col(value).cast("double").alias("_v"))
             for n, df in frames.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    names = list(frames)
    rows = rows.select("*", *[F.when(F.col("source_name") == n, F.col("_v")).alias(f"_v{i}") for i, n in enumerate(names)])
    by = [*order, "source_name"]

    def carried(w):
        return [F.coalesce(F.last(f"_v{i}", ignorenulls=True).over(w), F.col(f"_p{i}.v")).alias(n) for i, n in enumerate(names)]

    def totals(i):
        at = F.struct(*[F.col(c).alias(f"o{j}") for j, c in enumerate(by)], F.col(f"_v{i}").alias("v"))
        return F.max(F.when(F.col(f"_v{i}").isNotNull(), at)).alias(f"_t{i}")

    out = running_rows(rows, key, by, carried, [totals(i) for i in range(len(names))],
                       lambda w: [F.last(f"_t{i}", ignorenulls=True).over(w).alias(f"_p{i}") for i in range(len(names))])
    return out.select(*key, *by, *names)


def frequent_sequences(df: DataFrame, item: str, key: Sequence[str], order: Sequence[str], min_support: int, longest: int = 3) -> DataFrame:
    """``pattern`` (array of items), ``length`` and ``support``: the ordered patterns (gaps
    allowed) that occur in at least ``min_support`` keys.

    Prefix projection, a level at a time: a key that has a pattern is a row with the place
    where its first occurrence ends, and grows by the next place of every item behind that,
    looked up by an equi-join on (key, place). Next places are running minima from the end,
    split over blocks, so no key's sequence is in one task. A level joins only the rows of
    patterns that are frequent. The number of different items should be small (each is a
    column); rows without an item are left out."""
    key = list(key)
    rows = rows_index(df.filter(F.col(item).isNotNull()).select(*key, *order, F.col(item).cast("string").alias("_item")), key, order, name="_at")
    rows = materialize(rows.select(*key, "_item", "_at", (-F.col("_at")).alias("_back")))
    items = sorted(r[0] for r in rows.select("_item").distinct().collect())
    if not items:
        return df.sparkSession.createDataFrame([], "pattern array<string>, length int, support bigint")
    marks = rows.select(*key, "_at", "_back", *[F.when(F.col("_item") == t, F.col("_at")).alias(f"_i{i}") for i, t in enumerate(items)])
    following = running_rows(
        marks, key, ["_back"], lambda w: [F.least(F.min(f"_i{i}").over(w), F.col(f"_p{i}")).alias(f"_n{i}") for i in range(len(items))],
        [F.min(f"_i{i}").alias(f"_t{i}") for i in range(len(items))],
        lambda w: [F.min(f"_t{i}").over(w).alias(f"_p{i}") for i in range(len(items))])
    steps = F.array(*[F.struct(F.lit(t).alias("item"), F.col(f"_n{i}").alias("at")) for i, t in enumerate(items)])
    following = materialize(following.select(*key, "_at", F.filter(steps, lambda s: s["at"].isNotNull()).alias("_next")))

    out, level = None, following.filter("_at = 1").select(*key, F.explode("_next").alias("s")).select(
        *key, F.array("s.item").alias("pattern"), F.col("s.at").alias("_end"))
    for length in range(1, longest + 1):
        level = materialize(level)
        found = materialize(level.groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support))
        out = found if out is None else out.unionByName(found)
        if length < longest:
            grown = level.join(found.select("pattern"), "pattern", "left_semi").withColumn("_at", F.col("_end") + 1)
            level = null_safe_join(grown, following, [*key, "_at"]).select(*key, "pattern", F.explode("_next").alias("s")).select(
                *key, F.concat("pattern", F.array("s.item")).alias("pattern"), F.col("s.at").alias("_end"))
    return out.select("pattern", F.size("pattern").alias("length"), "support")
