"""Time the headline jobs on one scale factor and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned through the same ``queries()`` entry points the
correctness check uses and fully executed with the ``noop`` sink (no
driver collection). One warm-up, then the median of BENCH_REPEATS runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "status_report",       # MON9 flagship: one scan of the state + tiny aggregates
    "page_text",           # TXT9 over every page
    "site_text",           # PAG1-4: html -> one text per site
    "domain_resolved",     # DOM1-9 cascade (probe join + search hits)
    "classify_lexical",    # CLS3-4 sparse term scoring
    "stratified_sample",   # SMP1-2
    "taxonomy_discover",   # TAX10 TF-IDF + k-means
    "spend",               # MON6
    "gap_terms",           # TAX12
    "incremental_classify",  # STR1, 20 files in micro-batches
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from marketmap.plans.registry import QUERIES, load_all
    from marketmap.session import get_session

    load_all()
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus),
                        extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        fn = QUERIES[name]

        def run():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up: JIT, file listing, Python workers
        times[name] = round(statistics.median(run() for _ in range(repeats)), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
