"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The given tables are single row groups, which no scan can split. A cluster's
tables have many files, so they are laid out in one file per core before the
clock runs; the queries are the same on any layout.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from leafgrade.plans import load
from leafgrade.plans.registry import QUERIES
from leafgrade.session import local_session

HEADLINE = [
    "unit_totals", "allocate_blocks", "unit_asof", "verdict_blank", "verdict_choice", "verdict_matching", "verdict_totals",
    "gap_cluster_lines", "capped_clusters", "proximity_pairs", "iou_suppress", "row_bands", "normalize_text", "fingerprints",
    "quota_admission", "verified_requests", "cache_replay", "stage_durations", "answers_latest", "page_documents",
    "lesson_contexts", "key_entries",
]


def laid_out(spark, sf: str, files: int) -> str:
    """The tables of ``sf`` in a temporary folder, each in ``files`` files."""
    to = tempfile.mkdtemp(prefix="spark-bench-")
    for name in sorted(os.listdir(sf)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf}/{name}").repartition(files).write.parquet(f"{to}/{name}")
    return to


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    load()
    given, sf = sf, laid_out(spark, sf, int(cpus) if cpus.isdigit() else 8)
    # starts the JVM, the code generator and the Python workers before the clock runs
    QUERIES["verdict_server_blank"].build(spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(given.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
