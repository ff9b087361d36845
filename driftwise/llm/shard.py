"""Sharding along a Hilbert curve, with equal row counts.

Metadata dimensions (by default language, source and text size) are quantised to
``BITS`` bits each, order preserving: numbers on a logarithmic scale, strings by the
seven bytes behind the prefix that all values share, both scaled between the
smallest and the largest value. A row's cell is its point on the Hilbert curve
through that grid, so neighbouring rows on the curve are near in every dimension,
and cutting the curve into runs gives files whose min/max statistics are narrow in
all dimensions at once. Shard s holds the rows of rank floor(s * n / shards) up to
the next, so counts differ by one at most (law ``rows``).

Ranks without a global sort: rows are counted per cell (at most 2^MAX_CELL_BITS cells), a
cell is split by a hash of id and text into parts of about n / PARTS rows, and the
running sum over the at most cells + PARTS counted parts gives each part's first
rank. Rows are then numbered inside their part only, so a hot source, language or
group of equal texts is spread over many tasks.

Cases: null dimension values take cell 0 below all others; null or empty text has
size 8 and crc32 0; rows equal in every column are interchangeable and each gets a
slot of its own; rows equal in id and text but not in others are ordered by the
other columns' hash; an empty table gives an empty result; input columns named like
an output one are replaced. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, null_safe_join, packed, with_columns

BITS = 5
MAX_CELL_BITS = 15  # so at most 32,768 cells, whatever the dimensions
PARTS = 8192


def _prefix_number(c: Column, skip: int) -> Column:
    """Seven UTF-8 bytes behind the common prefix as a 56-bit number."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def _shared(a: str | None, b: str | None) -> int:
    """Length of the common prefix in bytes; between the extremes it holds for all."""
    x, y = (a or "").encode(), (b or "").encode()
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def quantised(df: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """One INT column in [0, 2^bits) per dimension; bounds from one aggregate."""
    probe = [f(F.col(d)).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    edge = df.agg(*probe).first()
    top, out = (1 << bits) - 1, []
    for i, d in enumerate(dims):
        lo, hi = edge[f"lo{i}"], edge[f"hi{i}"]
        if isinstance(df.schema[d].dataType, T.StringType):
            skip = _shared(lo, hi)
            number = lambda s, k=skip: int((s or "").encode()[k:k + 7].ljust(7, b"\0").hex(), 16)
            a, b, v = float(number(lo)), float(number(hi)), _prefix_number(F.col(d), skip).cast("double")
        else:
            a, b = (log2(1 + max(x or 0, 0)) for x in (lo, hi))
            v = F.log2(1 + F.greatest(F.col(d), F.lit(0)).cast("double"))
        cell = F.floor((v - F.lit(a)) / F.lit(max(b - a, 1e-9)) * F.lit(float(top)))
        cell = F.coalesce(cell, F.lit(0))  # least and greatest pass nulls over
        out.append(F.greatest(F.least(cell, F.lit(top)), F.lit(0)).cast("int"))
    return out


def hilbert_index(cells: DataFrame, axes: Sequence[str], bits: int, name: str) -> DataFrame:
    """Adds the Hilbert index of the integer point ``axes``: the axes are turned into
    the transposed index by exchanging and inverting low bits from the top bit down,
    Gray-decoded, and their bits interleaved. Every step is one projection."""
    work = [f"__x{i}" for i in range(len(axes))]
    df = cells.select("*", *[F.col(a).cast("int").alias(w) for a, w in zip(axes, work, strict=True)])
    first = work[0]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for w in work:
            swap = F.col(first).bitwiseXOR(F.col(w)).bitwiseAND(F.lit(low))
            isset = F.col(w).bitwiseAND(F.lit(bit)) != 0
            new_first = F.when(isset, F.col(first).bitwiseXOR(F.lit(low))).otherwise(F.col(first).bitwiseXOR(swap))
            new_own = F.when(isset, F.col(w)).otherwise(F.col(w).bitwiseXOR(swap))
            if w == first:
                df = df.withColumn(first, F.when(isset, F.col(first).bitwiseXOR(F.lit(low))).otherwise(F.col(first)))
            else:
                df = df.withColumns({first: new_first, w: new_own})
    for a, b in zip(work, work[1:], strict=False):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    fold = F.lit(0)
    for level in range(bits - 1, 0, -1):
        fold = fold.bitwiseXOR(F.when(F.col(work[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1))
                               .otherwise(F.lit(0)))
    df = df.withColumn("__fold", fold)
    df = df.withColumns({w: F.col(w).bitwiseXOR(F.col("__fold")) for w in work})
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for w in work:
            bit = F.shiftright(F.col(w), level).bitwiseAND(F.lit(1)).cast("long")
            index = index * 2 + bit
    return df.withColumn(name, index).drop("__fold", *work)


def shard(docs: DataFrame, shards: int = 24, dims: Sequence[str] | None = None, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bits: int = BITS,
          parts: int = PARTS) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes + 8), ``text_crc32``, ``hilbert``, ``shard``
    and ``slot`` (place in the shard along the curve). ``dims``: two or more columns to
    use in place of language, source and size."""
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)
    given = [F.col(f"`{d}`") for d in dims] if dims else [F.col(f"`{lang_col}`").cast("string"),
                                                        F.col(f"`{source_col}`").cast("string"), size]
    axes, places = [f"__d{i}" for i in range(len(given))], [f"__c{i}" for i in range(len(given))]
    bits = max(1, min(bits, MAX_CELL_BITS // len(given)))
    own = [g.alias(a) for g, a in zip(given, axes, strict=True)]
    spread = F.xxhash64(ident, text).bitwiseAND(F.lit((1 << 62) - 1)).alias("__h")
    slim = materialize(docs.select(*own, spread))
    quant = [q.alias(p) for q, p in zip(quantised(slim, axes, bits), places, strict=True)]
    slim = slim.select(*quant, "__h")

    cells = slim.groupBy(*places).agg(F.count(F.lit(1)).alias("__rows"))
    cells = hilbert_index(cells, places, bits, "__cell")
    total = slim.count()
    room = max(1, -(-total // parts))
    cells = cells.withColumn("__parts", F.ceil(F.col("__rows") / F.lit(room)).cast("long"))
    cells = materialize(cells.select(*places, "__cell", "__parts"))  # at most 2^MAX_CELL_BITS rows

    def part(df: DataFrame) -> DataFrame:
        # multiply-high of the hash keeps parts in hash order inside a cell
        p = F.least(F.floor(F.col("__h") / F.lit(float(1 << 62)) * F.col("__parts")), F.col("__parts") - 1)
        return null_safe_join(df, cells, places, small=True).withColumn("__part", p.cast("long"))

    counted = part(slim).groupBy("__cell", "__part").agg(F.count(F.lit(1)).alias("__rows"))
    along = Window.orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("__first", F.coalesce(F.sum("__rows").over(along), F.lit(0))).drop("__rows")
    first = materialize(first)  # at most cells + parts rows

    rows = docs.select(packed(docs), *own, spread, size.alias("__size"),
                       F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("__crc"))
    rows = rows.select("*", *quant)
    rows = null_safe_join(part(rows), first, ["__cell", "__part"], small=True)
    rest = F.xxhash64(*[F.col(f"__row.`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    inside = Window.partitionBy("__cell", "__part").orderBy("__h", rest)
    rows = rows.withColumn("__rank", F.col("__first") + F.row_number().over(inside) - 1)
    n = max(total, 1)
    # the s with floor(s * n / shards) <= rank < floor((s + 1) * n / shards)
    rows = rows.withColumn("__shard", F.expr(f"((__rank + 1) * {shards} - 1) DIV {n}"))
    start = F.expr(f"(__shard * {n}) DIV {shards}")
    return rows.select(*with_columns(docs, {
        "size": F.col("__size"), "text_crc32": F.col("__crc"), "hilbert": F.col("__cell"), "shard": F.col("__shard").cast("int"),
        "slot": (F.col("__rank") - start).cast("long")}))

