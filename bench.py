"""Headline-query timings: one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned by the library and fully executed into Spark's ``noop``
sink (all rows computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "validate_strict",      # clean stage
    "ohlcv_1h",             # time bars
    "normalize_minmax",     # row-frame normalisation (hot key split)
    "sma",                  # row-frame features on bars
    "rsi_14",
    "adaptive_threshold",   # windowed percentile
    "drift_adjacent",       # drift, window form
    "adwin_drift",          # drift, exact sequential form
    "cluster_change",
    "hst_scores",           # tree-based anomaly scores
    "explain_patterns",     # both detectors -> patterns -> text
    "events_query",
    "latency_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from driftwise.catalog import QUERIES
    from driftwise.session import local_session

    spark = local_session(cores=cpus, partitions=max(8, cpus))
    # warm-up: JVM classes, Python workers
    QUERIES["validate_strict"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
