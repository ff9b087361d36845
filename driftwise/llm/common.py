"""Helpers shared by the training-data operators: word and row-key expressions,
lineage cuts, and broadcasts behind a measured size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# ASCII blanks: space and \t \n \v \f \r. Words are the maximal runs of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD_RUN = "[^\\x20\\x09-\\x0D]+"

# Rows of a lookup table that may be broadcast; larger tables are shuffle-joined.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """ARRAY<STRING> of the words of ``text`` (null or blank text: empty array)."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(none)


def row_key(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a document by its id and whole text. Rows that repeat
    both are one document to the operators that join on this key."""
    flags = (id_col.isNull(), text.isNull())
    return F.xxhash64(id_col, text, *flags), F.xxhash64(F.lit("k2"), text, id_col, *flags)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in that folder: smaller than a checkpoint for tables of
    a row per line, sentence or shingle, and later reads take the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped.

    ``small``: the caller has a bound on the right side, so it is broadcast."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(F.broadcast(r) if small else r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``rows + 1`` rows of a materialised lookup table."""
    return df.limit(rows + 1).count() <= rows


def with_columns(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """Select list: the columns of ``docs`` under ``__row`` and the new ones; an
    input column whose name the operator also writes is replaced."""
    taken = {n.lower() for n in new}
    old = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c.lower() not in taken]
    return old + [c.alias(n) for n, c in new.items()]


def packed(docs: DataFrame) -> Column:
    """All input columns as one struct, so that no column of the operator's own
    can clash with one of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
