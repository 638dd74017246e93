"""Times the headline queries once warm, median of three runs; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from ledgerloom.plans.catalog import QUERIES
from ledgerloom.session import get_session

NAMES = ["event_rollup", "headline", "monthly", "industry", "quarterly_benchmark", "canonical_row", "grouped_events", "url_keys", "rejected_dedup", "company_key", "dedup_index", "islands_21", "same_company_pairs", "cross_name", "check_integrity", "advisories", "duplicate_sources", "cross_file", "patch_kth", "classify", "triage", "json_verdict", "eval_metrics", "event_hints", "window_groups"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = get_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline ledger queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
