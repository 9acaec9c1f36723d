"""Run each headline query once and summarise its final (adaptive) physical plan.

    python tools/plan_report.py [/root/testdata/sf0.1] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
         "Exchange RoundRobinPartitioning", "BroadcastExchange", "BroadcastHashJoin",
         "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "WindowGroupLimit",
         "TakeOrderedAndProject", "HashAggregate", "ObjectHashAggregate", "SortAggregate",
         "Window", "Generate", "MapInPandas", "FileScan parquet"]


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from bench import HEADLINE
    from marketmap.plans.registry import QUERIES, load_all
    from marketmap.session import get_session
    load_all()
    spark = get_session("local[8]", shuffle_partitions=8)
    print(f"# Plan summary ({os.path.basename(sf)}, final adaptive plans)\n")
    print("Counts of physical operators in the final plan of each headline query, and the")
    print("columns each parquet scan reads. Generated by `tools/plan_report.py`.\n")
    print("| query | " + " | ".join(n.replace("Exchange ", "X ").replace("partitioning", "")
                                     for n in NODES) + " |")
    print("|" + " --- |" * (len(NODES) + 1))
    scans = {}
    for name in HEADLINE:
        if name == "incremental_classify":
            continue
        plan = final_plan(QUERIES[name](spark, sf))
        counts = []
        for n in NODES:
            if n == "Window":
                c = len(re.findall(r"(?<![A-Za-z])Window \[", plan))
            else:
                c = plan.count(n)
            counts.append(str(c))
        print(f"| {name} | " + " | ".join(counts) + " |")
        scans[name] = sorted(set(
            f"{t} {rs}" for t, rs in re.findall(
                r"FileScan parquet [^\n]*?Location: [^\n]*?/([a-z_]+)\.parquet[^\n]*?"
                r"ReadSchema: (struct<[^>]*>)", plan)))
    print("\n## Columns read per scan\n")
    for name, s in scans.items():
        print(f"- **{name}**: " + "; ".join(f"`{x}`" for x in s))
    spark.stop()


if __name__ == "__main__":
    main()
