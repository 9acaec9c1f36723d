"""Command line over the modes: the original commands, with collected results as inputs.

    python -m marketmap --store PATH discover --input companies.csv --probes P --hits H --pages G
    python -m marketmap --store PATH classify --input companies.csv --probes P --hits H --pages G
    python -m marketmap --store PATH refresh-taxonomy [--force] [--dry-run]
    python -m marketmap --store PATH status | taxonomy-history
    python -m marketmap --store PATH export --output DIR
    python -m marketmap --store PATH retry-failed --probes P --hits H --pages G

Probe results (host, status_code), search hits (company_number, query_no, rank, link) and fetched
pages (host, path_ord, status_code, html) are Parquet tables collected outside this tool.
"""

from __future__ import annotations

import argparse
import json
import sys

from marketmap.constants import (
    CHECKPOINT_EVERY,
    REFRESH_EVERY,
    REFRESH_UNCLASSIFIED_THRESHOLD,
    REFRESH_WINDOW,
    SAMPLE_SIZE,
)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marketmap")
    p.add_argument("--store", help="state folder (default: under spark.checkpoint.dir)")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)

    def inputs(sp, need_input=True):
        if need_input:
            sp.add_argument("--input", required=True, help="companies CSV (file or folder)")
        sp.add_argument("--probes", required=True)
        sp.add_argument("--hits", required=True)
        sp.add_argument("--pages", required=True)

    d = sub.add_parser("discover")
    inputs(d)
    d.add_argument("--sample-size", type=int, default=SAMPLE_SIZE)
    c = sub.add_parser("classify")
    inputs(c)
    c.add_argument("--limit", type=int, default=None)
    c.add_argument("--output", default=None)
    c.add_argument("--chunk", type=int, default=CHECKPOINT_EVERY, help="rows between two checks of the trigger")
    c.add_argument("--window", type=int, default=REFRESH_WINDOW)
    c.add_argument("--threshold", type=float, default=REFRESH_UNCLASSIFIED_THRESHOLD)
    c.add_argument("--every", type=int, default=REFRESH_EVERY)
    c.add_argument("--run-id", default=None, help="goes on with an interrupted run")
    r = sub.add_parser("refresh-taxonomy")
    r.add_argument("--force", action="store_true")
    r.add_argument("--dry-run", action="store_true")
    sub.add_parser("status")
    sub.add_parser("taxonomy-history")
    e = sub.add_parser("export")
    e.add_argument("--output", required=True)
    t = sub.add_parser("retry-failed")
    inputs(t, need_input=False)
    return p


def main(argv=None) -> int:
    args = _parser().parse_args(argv)
    from marketmap.operators.retry import retry_counts
    from marketmap.plans import modes
    from marketmap.session import get_session
    from marketmap.sources.companies import read_companies

    spark = get_session(args.master)
    store = modes.ResearchStore(spark, args.store)

    def tables():
        return (spark.read.parquet(args.probes), spark.read.parquet(args.hits),
                spark.read.parquet(args.pages))

    if args.cmd == "discover":
        v = modes.discover(store, read_companies(spark, args.input), *tables(),
                           sample_size=args.sample_size)
        if v is None:
            print("No services descriptions to cluster on - aborting.")
            return 1
        print(f"Saved taxonomy version {v}")
    elif args.cmd == "classify":
        out = modes.classify(store, read_companies(spark, args.input), *tables(),
                             limit=args.limit, chunk=args.chunk, window=args.window,
                             threshold=args.threshold, every=args.every, run_id=args.run_id)
        print(json.dumps(out, default=str))
        if args.output:
            print(f"Exported {modes.export(store, args.output)} rows to {args.output}")
    elif args.cmd == "refresh-taxonomy":
        out = modes.refresh(store, "manual", force=args.force, dry_run=args.dry_run)
        print(json.dumps(out, default=str))
        return 0 if out.get("accepted") or args.dry_run else 2
    elif args.cmd == "status":
        modes.status(store).show(100, truncate=False)
    elif args.cmd == "taxonomy-history":
        modes.history(store).show(100, truncate=False)
    elif args.cmd == "export":
        print(f"Exported {modes.export(store, args.output)} rows to {args.output}")
    elif args.cmd == "retry-failed":
        done = modes.retry_failed(store, *tables())
        print(f"Retried {done['retried']} errored rows")
        if done["retried"]:
            report = modes.retry_report(store, done["first_batch"], done["end_batch"])
            retry_counts(report).orderBy("outcome").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
