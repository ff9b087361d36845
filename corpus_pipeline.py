"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, mixing
and sharding, each stage over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet into the shared checkpoint folder and reads again for the next one. All but the last return
the columns of ``documents``; the last adds shard and slot. The columns of docs that
the stages read are doc_id, text, lang and source; null, empty and repeated values are
handled as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftwise.llm.common import table
from driftwise.llm.decontaminate import decontaminate
from driftwise.llm.mix import take
from driftwise.llm.quality import reject
from driftwise.llm.shard import shard
from driftwise.llm.simhash import near_dedup
from driftwise.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their group's ellipsoid."""
    return reject(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component, the one with the smallest id."""
    return near_dedup(docs, shingle=4, max_bits=4)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot along the Hilbert curve."""
    placed = shard(docs)
    return placed.select(*docs.columns, "hilbert", "shard", "slot")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

# The SimHash stage hashes with XXH64 and the mix cuts by its own hash order, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
