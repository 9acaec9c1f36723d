"""Run a registered Spark query and its DuckDB oracle on the same parquet and
compare row count, column names and an order-insensitive multiset of rows.

    python -m tests.harness [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

from marketmap.plans.fixtures import BASE_TABLES


def _connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def oracle_frame(sql: str, sf_dir: str) -> pd.DataFrame:
    return _connect(sf_dir).execute(sql).fetch_df()


# Spark simpleString -> DuckDB type name, for the schema comparison.
SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                   "boolean": "BOOLEAN", "array<string>": "VARCHAR[]",
                   "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def type_mismatches(spark_df, sql: str, sf_dir: str) -> list:
    rel = _connect(sf_dir).sql(sql)
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in spark_df.schema.fields:
        want = SPARK_TO_DUCKDB.get(f.dataType.simpleString(), f.dataType.simpleString())
        if duck.get(f.name) != want:
            out.append((f.name, f.dataType.simpleString(), duck.get(f.name)))
    return out


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 9)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo \
            else pd.Timestamp(v).isoformat()
    if v is pd.NaT:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in row) for row in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark_pd: pd.DataFrame, oracle_pd: pd.DataFrame) -> tuple[bool, str]:
    sc, oc = sorted(spark_pd.columns), sorted(oracle_pd.columns)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(spark_pd) != len(oracle_pd):
        return False, f"row count spark={len(spark_pd)} oracle={len(oracle_pd)}"
    a, b = rows_of(spark_pd), rows_of(oracle_pd)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(x != y for x, y in zip(a, b))} rows), e.g. {diff}"
    return True, f"{len(a)} rows"


def check(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    from marketmap.plans.registry import ORACLES, QUERIES, load_all
    load_all()
    t0 = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in ORACLES:
        return True, f"{len(got)} rows (no oracle) spark={t1 - t0:.1f}s"
    want = oracle_frame(ORACLES[name], sf_dir)
    ok, msg = compare(got, want)
    return ok, f"{msg} spark={t1 - t0:.1f}s"


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    from marketmap.plans.registry import QUERIES, load_all
    from marketmap.session import get_session
    load_all()
    spark = get_session("local[8]", shuffle_partitions=8)
    names = args.names or sorted(QUERIES)
    bad = 0
    for n in names:
        try:
            ok, msg = check(spark, n, args.sf)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
