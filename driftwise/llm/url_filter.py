"""URL filter by a sorted digest array.

The rule list is compiled once into a binary index: the 64-bit xxhash keys of all
rule strings in ascending order, and beside each key its verdict and the place of
its full string. The index is written to the shared checkpoint folder and handed
to the executors by ``SparkContext.addFile`` (an executor that joins later, or
replaces a lost one, fetches it again); tasks memory-map it, so the list takes
page cache and not Python heap. A URL is turned into its candidate rule strings -
every host suffix with every path prefix whose length occurs among the rules -
whose digests are probed by one vectorised binary search per batch; each hit is
confirmed against the stored string, so equal digests of different strings never
give a verdict.

Lists whose index would exceed ``max_index_bytes`` are not shipped but joined by
shuffle on the candidate strings (``filter_urls_by_join``), with equal results.

Cases: a null URL or one without ``://`` has an empty host and path and gets the
default verdict; repeated rows each get a row; an empty table gives an empty
result; of two rules that fit, the longer string wins (on equal length the longer
host); rules repeated in the list count once (the last verdict); input columns
named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .common import packed, with_columns

Rule = tuple[str, str, str]  # verdict, host, path

MAX_INDEX_BYTES = 1 << 30
_HEAD = "<QQQ"  # rules, path lengths, bytes of strings
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def compile_index(rules: Sequence[Rule]) -> bytes:
    """Header, sorted keys (u64), string offsets (u64, one more), block flags (u8),
    path lengths that occur (u32), all strings."""
    last = {host.translate(_LOWER) + path: verdict for verdict, host, path in rules}
    lengths = sorted({len(s) - s.index("/") if "/" in s else 0 for s in last})
    rows = sorted((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")), s, v) for s, v in last.items())
    texts = [s.encode("utf-8", "surrogatepass") for _, s, _ in rows]
    keys = np.array([k for k, _, _ in rows], dtype="<u8")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype="<u8")]).astype("<u8")
    block = np.array([v == "block" for _, _, v in rows], dtype="u1")
    blob = b"".join(texts)
    return (struct.pack(_HEAD, len(rows), len(lengths), len(blob)) + keys.tobytes() + offsets.tobytes()
            + np.array(lengths, dtype="<u4").tobytes() + block.tobytes() + blob)


class DigestArray:
    """Memory-mapped view of a compiled index."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        n, m, size = struct.unpack(_HEAD, raw[:struct.calcsize(_HEAD)].tobytes())
        at = struct.calcsize(_HEAD)
        self.keys = raw[at:at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.lengths = raw[at:at + 4 * m].view("<u4").tolist()
        at += 4 * m
        self.block = raw[at:at + n]
        self.strings = raw[at + n:at + n + size]

    def probe(self, candidates: list[str]) -> np.ndarray:
        """Index of each candidate's rule, or -1. One binary search for all; runs of
        equal digests are walked and the stored string decides."""
        out = np.full(len(candidates), -1, dtype="i8")
        if not candidates or not len(self.keys):
            return out
        texts = [c.encode("utf-8", "surrogatepass") for c in candidates]
        digests = np.fromiter(map(xxhash.xxh64_intdigest, texts), dtype="u8", count=len(texts))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in hit:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.strings[int(self.offsets[j]):int(self.offsets[j + 1])].tobytes() == texts[i]:
                    out[i] = j
                    break
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


def candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Rule strings that would fit, longest first (then the longer host first)."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [h + p for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def _ship(spark, index: bytes) -> str:
    """Write the index to the shared checkpoint folder and register it with Spark."""
    name = f"urlrules-{hashlib.sha256(index).hexdigest()[:20]}.bin"
    where = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        for i in range(0, len(index), 1 << 20):
            out.write(bytearray(index[i:i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow",
                max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the winning rule's string or
    null) and ``verdict``: the rule's, or ``default`` where none is on the list.
    A rule fits its host and all subdomains if the path starts with the rule's."""
    index = compile_index(rules)
    if len(index) > max_index_bytes:
        return filter_urls_by_join(pages, rules, url_col, default)
    name = _ship(pages.sparkSession, index)
    added = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules_here = DigestArray(SparkFiles.get(name))
        for urls in batches:
            parts = [split_url(u) for u in urls]
            lists = [candidates(h, p, rules_here.lengths) if h else [] for h, p in parts]
            found = rules_here.probe([c for own in lists for c in own])
            rule, verdict, at = [], [], 0
            for own in lists:
                best = next((k for k in range(len(own)) if found[at + k] >= 0), None)
                rule.append(None if best is None else own[best])
                verdict.append(default if best is None else "block" if rules_here.block[found[at + best]] else "allow")
                at += len(own)
            yield pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts],
                                "rule": pd.Series(rule, dtype=object), "verdict": verdict}, index=urls.index)

    judged = F.pandas_udf(judge, added)
    out = pages.select(packed(pages), judged(F.col(f"`{url_col}`").cast("string")).alias("__j"))
    return out.select(*with_columns(pages, {c: F.col(f"__j.{c}") for c in added.names}))


def filter_urls_by_join(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url",
                        default: str = "allow") -> DataFrame:
    """The same verdicts by a shuffle join of candidate strings with the rules:
    the way for lists too large to ship."""
    spark = pages.sparkSession
    last = {host.translate(_LOWER) + path: verdict for verdict, host, path in rules}
    listed = spark.createDataFrame([(s, v) for s, v in last.items()], "__c string, __v string")
    lengths = sorted({len(s) - s.index("/") if "/" in s else 0 for s in last})
    # an empty url stands for null and for one without "://": host and path are empty
    url = F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), "(?s)://.*$", 0)
    base = pages.select(packed(pages), F.regexp_extract(url, "(?s)^://([^/?#]*)", 1).alias("__h0"),
                        F.regexp_extract(url, "(?s)^://[^/?#]*([^?#]*)", 1).alias("__path"))
    base = base.withColumn("__host", F.translate("__h0", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    keys = base.select("__host", "__path").distinct()
    labels = keys.withColumn("__l", F.split("__host", "\\."))
    hosts = labels.select("__host", "__path", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("__l")), lambda i: F.array_join(F.slice(F.col("__l"), i, F.size("__l")), "."))
    ).alias("__i", "__hs")).filter(F.col("__host") != "")
    cands = hosts.select("__host", "__path", "__hs", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("__n"))
    cands = cands.filter(F.col("__n") <= F.length("__path")).withColumn(
        "__c", F.concat("__hs", F.col("__path").substr(F.lit(1), F.col("__n"))))
    best = cands.join(listed, "__c").groupBy("__host", "__path").agg(
        F.max(F.struct(F.length("__c").alias("n"), F.length("__hs").alias("h"), F.col("__c").alias("c"),
                       F.col("__v").alias("v"))).alias("__b"))
    out = base.join(best, ["__host", "__path"], "left")
    return out.select(*with_columns(pages, {
        "host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__b.c"),
        "verdict": F.coalesce(F.col("__b.v"), F.lit(default))}))
