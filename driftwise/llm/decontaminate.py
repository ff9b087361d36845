"""Benchmark decontamination: short test items found inside long documents.

An item is the set of its 5-word shingles (letters and digits only, lower case; an
item of fewer words is one shingle of all its words). A document contains an item
if at least 80 % of the item's shingles occur anywhere in it.

Containment of a small set in a large one is searched with a MinHash sketch of the
small side only: items are partitioned by their number of shingles (upper sizes 1, 2, 4, 8, ...), and the sketch
of an item is the smallest hashes of its set, as many as its partition's largest
size allows to be missing, plus one. A document that contains the item misses at most
that many less one, so it holds one of the sketch's shingles: candidate search
loses nothing, however long the document is. Candidates are then verified
by the exact count of the item's distinct shingles in the document.

Scale: documents are shingled in a stream inside generated code (the array of words
zipped with its own shifts) and the shingles meet the item table in a broadcast
join behind a count of its rows (else a shuffle join, whose skewed parts adaptive
execution splits), so document shingles are not shuffled. What is grouped is one row per
document and matched shingle. Verification re-reads candidate documents only.

Cases: null, empty or short texts hold no 5-word shingle; items without words are
never found; repeated item rows count once (items of one id with other texts each for themselves); rows equal in id and
text are one document (one result row per item); with an empty table on either side
the result is empty; extra columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize, null_safe_join, packed, row_key

WORDS = 5
CONTAINMENT = 0.8


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    kept = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(F.length(kept) > 0, F.split(kept, " ")).otherwise(F.array().cast("array<string>"))


def shingle_rows(df: DataFrame, text: Column, n: int, *keep: str) -> DataFrame:
    """One row ``(keep..., __s)`` per ``n``-word window, repeats included."""
    w = df.select(*keep, plain_words(text).alias("__w"))
    names = [f"w{i}" for i in range(n)]
    shifts = [F.slice("__w", F.lit(i + 1), F.greatest(F.size("__w") - (n - 1), F.lit(0))).alias(x)
              for i, x in enumerate(names)]
    return w.select(*keep, F.inline(F.arrays_zip(*shifts)).alias(*names)).select(
        *keep, F.xxhash64(*names).alias("__s"))


def item_shingles(items: DataFrame, id_col: str, text_col: str, n: int, share: float) -> DataFrame:
    """``(__item, __n, __s, __size, __sketch)``: every item's distinct shingles, and
    whether a shingle belongs to the item's sketch."""
    own = items.select(F.col(f"`{id_col}`").alias("__item"), F.col(f"`{text_col}`").cast("string").alias("__t"))
    own = own.withColumn("__len", F.size(plain_words(F.col("__t")))).filter("__len > 0").distinct()
    own = own.withColumn("__n", F.least(F.col("__len"), F.lit(n)))
    out = None
    for k in range(1, n + 1):
        part = shingle_rows(own.filter(F.col("__n") == k), F.col("__t"), k, "__item", "__n", "__t").distinct()
        out = part if out is None else out.unionByName(part)
    sets = out.groupBy("__item", "__n", "__t").agg(F.array_sort(F.collect_set("__s")).alias("__set"))
    size = F.size("__set")
    upper = F.pow(F.lit(2.0), F.ceil(F.round(F.log2(size.cast("double")), 9)).cast("double"))
    missing = F.floor(F.round((1 - F.lit(share)) * upper, 9))
    sets = sets.withColumn("__size", size).withColumn("__m", missing + 1)
    # the item's row is told from others with its id by its text
    return sets.select("__item", F.xxhash64("__t").alias("__ik"), "__n", "__size", "__m",
                       F.posexplode("__set").alias("__pos", "__s")).select(
        "__item", "__ik", "__n", "__size", "__s", (F.col("__pos") < F.col("__m")).alias("__sketch"))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS,
               containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, shared, item_shingles, containment, __k1, __k2)``: one row
    per document and item it contains; ``__k1, __k2`` name the document."""
    listed = materialize(item_shingles(items, item_col, item_text_col, n, containment))
    small = is_small(listed)
    lengths = [r[0] for r in listed.select("__n").distinct().collect()]  # at most n values
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    k1, k2 = row_key(ident, text)
    own = docs.select(ident.alias("__id"), text.alias("__text"), k1.alias("__k1"), k2.alias("__k2"))

    def meet(df: DataFrame, table: DataFrame) -> DataFrame:
        out = None
        for k in sorted(lengths):
            rows = shingle_rows(df, F.col("__text"), k, "__k1", "__k2", "__id")
            part = table.filter(F.col("__n") == k).drop("__n")
            part = rows.join(F.broadcast(part) if small else part, "__s")
            out = part if out is None else out.unionByName(part)
        return out

    if not lengths:  # no item has a word
        lengths = [n]
    who = ["__k1", "__k2", "__id", "__item", "__ik"]
    sketch = listed.filter("__sketch").drop("__sketch")
    cand = materialize(meet(own, sketch).select(*who).distinct())
    few = is_small(cand)
    keys = cand.select("__k1", "__k2").distinct()
    again = own.join(F.broadcast(keys) if few else keys, ["__k1", "__k2"], "left_semi")
    hits = meet(again, listed.drop("__sketch"))
    count = hits.groupBy(*who, "__size").agg(F.count_distinct("__s").alias("shared"))
    count = null_safe_join(count, cand, ["__k1", "__k2", "__item", "__ik"], how="left_semi", small=few)
    share = F.col("shared") / F.col("__size")
    return count.filter(share >= containment - 1e-12).select(
        F.col("__id").alias(id_col), F.col("__item").alias(item_col), "shared",
        F.col("__size").cast("long").alias("item_shingles"), share.alias("containment"), "__k1", "__k2")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
                  ) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    bad = materialize(find_items(docs, items, id_col, text_col, **options).select("__k1", "__k2").distinct())
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    k1, k2 = row_key(ident, text)
    rows = docs.select(packed(docs), k1.alias("__k1"), k2.alias("__k2"))
    bad = F.broadcast(bad) if is_small(bad) else bad
    return rows.join(bad, ["__k1", "__k2"], "left_anti").select("__row.*")
