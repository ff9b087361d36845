"""Row-frame ("last N rows per key") planning that survives hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; with
the reference's per-source state one key is a whole source. Here a key is cut
into blocks of consecutive rows, and a block also receives a *halo* - at least the
``lookback`` rows that precede it - so any frame reaching at most ``lookback`` rows
back is computed exactly inside the block:

1. Bounds from a sample of (key, order columns), sorted, cut the rows into chunks, about
   ``CHUNKS`` a block. The whole order tuple counts, so rows with one time (or no time)
   are cut too. A row finds its chunk by a binary search over the bounds.
2. Rows are counted per (key, chunk) (partial aggregation over the key and order columns
   alone). Running sums over a key's chunks give each chunk's place in the key: its block,
   the later blocks it is halo for, and where the block's row numbers start. Only keys
   of more than a block need this, so the table has at most as many rows as there are
   chunks and blocks; that table, not the counts, is broadcast.
3. Rows go to (key, block), halo chunks to the next blocks as well: the one shuffle of the
   rows. The caller's window expressions run there and halo copies are dropped.

A window group holds about ``TARGET_ROWS`` at most, less where that gives all cores a
block; the law is the same for any size (``block_rows``), and results are
identical to the single-partition window. Past ``MAX_CHUNKS`` chunks (6.5 * 10^10 rows)
blocks grow with the table, and Spark's windows spill. Order columns must form a unique,
deterministic order (e.g. ``(timestamp, event_id)``); rows equal in all of them stay
together in one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

# Rows a window group may hold, and below which cutting a key further gains nothing.
TARGET_ROWS = 1_000_000
LEAST_ROWS = 4_096
# Chunks a block is made of, chunks in all, and sampled rows a chunk and in all.
CHUNKS = 16
MAX_CHUNKS = 1 << 18
SAMPLE_PER_CHUNK = 8
MAX_SAMPLE = 1 << 20


@dataclass
class Frame:
    """What a builder gets: the window spec to use and the exact row index."""

    w: WindowSpec  # partitioned by key (+ block), ordered by the order columns
    rn: Column  # 1-based position of the row within its key

    def rows(self, n: int) -> WindowSpec:
        """Frame of the last ``n`` rows ending at the current row."""
        return self.w.rowsBetween(-(n - 1), 0)


def block_rows_for(rows: int, cores: int) -> int:
    """Rows meant for a block: a core's share, within LEAST_ROWS .. TARGET_ROWS. Blocks are
    cut at four fifths of that, so that whole chunks and the halo fit in."""
    share = min(TARGET_ROWS, max(LEAST_ROWS, -(-rows // max(cores, 1))))
    return max(1, share * 4 // 5)


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], broadcast: bool = False, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    if broadcast:
        r = F.broadcast(r)
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_r_{c}"]) for c in cols], F.lit(True))
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{c}" for c in cols])


def has_shuffle(df: DataFrame) -> bool:
    """True when the DataFrame's physical plan already contains a shuffle (a broadcast
    is cheap to repeat and does not count)."""
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    except Exception:  # noqa: BLE001 - not a classic DataFrame
        return False
    return re.search(r"(?<!Broadcast)Exchange", plan) is not None


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder
    (``spark.checkpoint.dir``; a scratch folder only when unset, e.g. tests), so
    the planning passes below do not recompute an expensive input and a lost
    executor does not replay it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bounds(df: DataFrame, cols: Sequence[str], n: int, rows: int) -> list:
    """At most ``n - 1`` ascending distinct tuples that cut the rows into about ``n`` equal
    parts, from a sample of a bounded number of tuples (as Spark's range partitioning takes)."""
    want = min(n * SAMPLE_PER_CHUNK, MAX_SAMPLE)
    share = min(1.0, want / max(rows, 1))
    some = df.select(F.struct(*cols).alias("q"))
    some = (some.sample(share, seed=11) if share < 1 else some).orderBy("q").select("q.*")
    values = some.collect()
    cut = [values[i * len(values) // n] for i in range(1, n)] if values else []
    return [q for i, q in enumerate(cut) if i == 0 or q != cut[i - 1]]


def _locate(df: DataFrame, cols: Sequence[str], bounds: list) -> DataFrame:
    """Add ``_chunk``: how many bounds are at or below the row's tuple, by a binary search
    of one comparison a step. Plain expressions, so Spark compiles them; past the last
    bound there is no tuple and the comparison is null."""
    schema = df.select(*cols).schema
    kind = T.ArrayType(T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)]))
    held = df.sparkSession.createDataFrame([([tuple(q) for q in bounds],)], T.StructType([T.StructField("b", kind)]))
    out = df.withColumn("_q", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])).withColumn("_chunk", F.lit(0))
    step = (1 << len(bounds).bit_length()) >> 1
    while step:
        probe = F.get(held.scalar(), F.col("_chunk") + F.lit(step - 1))
        out = out.withColumn("_chunk", F.when(probe <= F.col("_q"), F.col("_chunk") + F.lit(step)).otherwise(F.col("_chunk")))
        step >>= 1
    return out.drop("_q")


def place(df: DataFrame, key: Sequence[str], order: Sequence[str], lookback: int = 0, block_rows: int | None = None,
          n_chunks: int | None = None, most: int | None = None) -> DataFrame:
    """Rows with ``_blk`` (block within the key), ``_h`` (1: halo copy) and ``_off`` (row
    number of the block's first row, halo included, less one), not yet shuffled.

    ``block_rows`` or ``n_chunks`` (rows / n_chunks) replace the law for a block's size;
    ``most`` bounds it."""
    key, order = list(key), list(order)
    cols = list(dict.fromkeys([*key, *order]))
    lookback = max(int(lookback), 0)
    if has_shuffle(df):
        df = materialize(df)
    rows = df.count()
    b = block_rows or (max(1, rows // n_chunks) if n_chunks else block_rows_for(rows, df.sparkSession.sparkContext.defaultParallelism))
    b = max(min(b, most or b), -(-rows * CHUNKS // MAX_CHUNKS // 4))
    n = min(MAX_CHUNKS, -(-rows * CHUNKS // b))
    zero = F.lit(0)
    if rows <= b:
        return df.select("*", zero.cast("long").alias("_blk"), zero.alias("_h"), zero.cast("long").alias("_off"))
    located = _locate(df, cols, _bounds(df, cols, n, rows))
    counts = located.groupBy(*key, "_chunk").agg(F.count(F.lit(1)).alias("_cn"))
    whole = Window.partitionBy(*key)
    c = counts.select(*key, "_chunk", "_cn", F.sum("_cn").over(whole).alias("_total"),
                      (F.sum("_cn").over(whole.orderBy("_chunk")) - F.col("_cn")).alias("_before"))
    c = c.filter(F.col("_total") > b).withColumn("_blk", F.floor(F.col("_before") / F.lit(b)).cast("long"))
    own = c.select(*key, "_chunk", "_cn", "_blk", zero.alias("_h"), "_before")
    entries = own
    if lookback:
        last = F.floor((F.col("_before") + F.col("_cn") + F.lit(lookback - 1)) / F.lit(b)).cast("long")
        halo = c.filter(last > F.col("_blk")).select(*key, "_chunk", "_cn", (F.col("_before") + F.col("_cn")).alias("_end"),
                                                     F.explode(F.sequence(F.col("_blk") + 1, last)).alias("_blk"))
        starts = c.groupBy(*key, "_blk").agg(F.min("_before").alias("_s"))
        halo = null_safe_join(halo, starts, [*key, "_blk"]).filter(F.col("_s") < F.col("_end") + F.lit(lookback))
        entries = own.unionByName(halo.select(*key, "_chunk", "_cn", "_blk", F.lit(1).alias("_h"), F.lit(None).cast("long").alias("_before")))
    w = Window.partitionBy(*key, "_blk")
    off = F.min("_before").over(w) - F.sum(F.when(F.col("_h") == 1, F.col("_cn")).otherwise(0)).over(w)
    to = entries.withColumn("_off", off).groupBy(*key, "_chunk").agg(F.collect_list(F.struct("_blk", "_h", "_off")).alias("_to"))
    # at most a row a chunk and block, whatever the number of rows and keys
    placed = null_safe_join(located, to, [*key, "_chunk"], broadcast=True, how="left")
    first = F.array(F.struct(zero.cast("long").alias("_blk"), zero.alias("_h"), zero.cast("long").alias("_off")))
    return placed.withColumn("_to", F.explode(F.coalesce("_to", first))).select(*df.columns, "_to._blk", "_to._h", "_to._off")


def _block_frame(key: Sequence[str], order: Sequence[str]) -> Frame:
    w = Window.partitionBy(*key, "_blk").orderBy(*order)
    return Frame(w=w, rn=F.col("_rn"))


def over_rows(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    lookback: int,
    build: Callable[[Frame], Sequence[Column]],
    split: bool = True,
    n_chunks: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add the columns ``build(frame)`` returns; every frame may reach at most
    ``lookback`` rows before the current one.

    ``split=False`` uses one window partition per key (one shuffle; fine when
    keys are many and none is hot)."""
    key, order = list(key), list(order)
    if not split:
        w = Window.partitionBy(*key).orderBy(*order)
        fr = Frame(w=w, rn=F.row_number().over(w))
        return _apply(df, build(fr))
    placed = place(df, key, order, lookback, block_rows, n_chunks)
    fr = _block_frame(key, order)
    numbered = placed.withColumn("_rn", F.col("_off") + F.row_number().over(fr.w))
    return _apply(numbered, build(fr)).filter(F.col("_h") == 0).drop("_h", "_blk", "_off", "_rn")


def _apply(df: DataFrame, cols) -> DataFrame:
    """``cols`` is a list of columns, or a list of stages (lists) applied in turn
    (later stages may use window results of earlier ones over the same spec)."""
    cols = list(cols)
    stages = cols if cols and isinstance(cols[0], (list, tuple)) else [cols]
    for stage in stages:
        df = df.select("*", *stage)
    return df


def index_within_key(df: DataFrame, key: Sequence[str], order: Sequence[str], n_chunks: int | None = None) -> DataFrame:
    """Add ``_rn`` (1-based row index within key, in ``order``) and ``_chunk`` (the block of
    the key that the row was numbered in)."""
    placed = place(df, key, order, n_chunks=n_chunks)
    numbered = placed.withColumn("_rn", F.col("_off") + F.row_number().over(_block_frame(key, order).w))
    return numbered.withColumnRenamed("_blk", "_chunk").drop("_h", "_off")


def rows_index(df: DataFrame, key: Sequence[str], order: Sequence[str], split: bool = True,
               name: str = "rn", n_chunks: int | None = None) -> DataFrame:
    """Public form of the row index: adds ``name`` = 1-based position within key."""
    if not split:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w))
    return index_within_key(df, key, order, n_chunks).withColumnRenamed("_rn", name).drop("_chunk")


def running_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], build: Callable[[WindowSpec], Sequence[Column]],
                 totals: Sequence[Column], merge: Callable[[WindowSpec], Sequence[Column]], lookback: int = 0,
                 first: Callable[[Frame], Sequence[Column]] | None = None) -> DataFrame:
    """Cumulative values per key, block by block: ``totals`` (named aggregates of a block) are
    prefixed over a key's earlier blocks by ``merge`` (named columns over a window of blocks)
    and joined to the rows of the later blocks, null in a key's first; ``build`` then
    gives the row's columns from these and the running window of its block. Columns of
    ``first``, over frames that reach at most ``lookback`` rows back, are there for the totals."""
    key = list(key)
    placed = place(df, key, order, lookback)
    if first is not None:
        placed = _apply(placed, first(_block_frame(key, order))).filter(F.col("_h") == 0)
    blocks = placed.groupBy(*key, "_blk").agg(*totals)
    earlier = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    merged = list(merge(earlier))
    carried = blocks.select(*key, "_blk", *merged).filter("_blk > 0")  # at most a row a block
    joined = null_safe_join(placed, carried, [*key, "_blk"], broadcast=True, how="left")
    names = [c for c in carried.columns if c not in (*key, "_blk")]
    inner = Window.partitionBy(*key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("*", *build(inner)).drop("_blk", "_h", "_off", *names)
