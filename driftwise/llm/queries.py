"""Registered queries ``opN_<name>`` over the driver tables and, where SQL can state
the same computation, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import classify
from .common import table
from .decontaminate import find_items
from .license_scan import scan_licences
from .linededup import dedup_lines
from .mix import mix
from .oracle import ORACLE
from .phrases import mine_phrases
from .quality import quality_rules
from .shard import shard
from .simhash import near_duplicates
from .spandedup import dedup_spans
from .topk import top_k
from .trie import prefix_trie
from .url_filter import filter_urls

__all__ = ["ORACLE", "QUERIES"]

# The rules of the URL query: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_mix(spark, sf_dir):
    """Mix of all documents: sources weigh 1, 2, 3 in turn and share all words."""
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_line_dedup(spark, sf_dir):
    """Lines of all documents without later occurrences of three-line windows."""
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.md5("text").alias("clean_md5"))


def files(spark, sf_dir) -> DataFrame:
    """Stand-in for a table of repository files (path, text): every document is a file,
    in directories by source, language and id; a few are named LICENSE."""
    d = documents(spark, sf_dir)
    top, sub = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    deep = F.concat_ws("/", top, sub, F.floor(F.col("doc_id") / 64).cast("string"))
    where = F.when(F.col("doc_id") % 97 == 0, top).when(F.col("doc_id") % 97 == 1, F.concat_ws("/", top, sub)).otherwise(deep)
    name = F.when((F.col("doc_id") % 97 < 2) | (F.col("doc_id") % 16 == 5), "LICENSE").otherwise(
        F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.concat_ws("/", where, name).alias("path"), "text", "doc_id")


def op3_license_scan(spark, sf_dir):
    """Licence of every file, its own or its nearest ancestor directory's."""
    return scan_licences(files(spark, sf_dir), keep=["doc_id"])


def op4_decontaminate(spark, sf_dir):
    """Every document and benchmark item it contains to 80 % or more."""
    found = find_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("__k1", "__k2")


def op5_span_dedup(spark, sf_dir):
    """Sentences of all documents without later occurrences of repeated spans."""
    return dedup_spans(documents(spark, sf_dir)).select(
        "doc_id", "n_sentences", "n_removed", "removed_spans", F.md5("text").alias("clean_md5"))


def held_out(ident):
    return F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 4 == 2


def op6_quality_score(spark, sf_dir):
    """Quality score of every document; rows with remainder 2 are never learned from."""
    scored = classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), trainable=~held_out(F.col("__id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document."""
    judged = quality_rules(documents(spark, sf_dir), keep_columns=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept")


def op8_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_hilbert_shards(spark, sf_dir):
    """Shard and slot of every document along the Hilbert curve."""
    placed = shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op10_url_filter(spark, sf_dir):
    """Verdict on the URL of every page; a URL on no list is allowed."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark, sf_dir):
    """Trie of all conversations, their heads taken from the first of each twenty."""
    return prefix_trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 20,
                       head=lambda c: F.crc32(F.encode(c.cast("string"), "UTF-8")) % 4)


def op12_phrases(spark, sf_dir):
    """The 2,000 strongest phrases of every language of all documents."""
    return mine_phrases(documents(spark, sf_dir))


def op13_topk(spark, sf_dir):
    """The ten best rows for every hundredth vector, against all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_line_dedup, op3_license_scan, op4_decontaminate, op5_span_dedup, op6_quality_score, op7_quality_rules,
    op8_simhash, op9_hilbert_shards, op10_url_filter, op11_prefix_trie, op12_phrases, op13_topk)}
