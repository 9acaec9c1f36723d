"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import pytest

from marketmap.plans.registry import ORACLES, QUERIES, load_all
from tests.conftest import SF_SMALL
from tests.harness import compare, oracle_frame, type_mismatches

load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert type_mismatches(df, ORACLES[name], SF_SMALL) == []
    got = df.toPandas()
    want = oracle_frame(ORACLES[name], SF_SMALL)
    ok, msg = compare(got, want)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    rows = df.collect()
    assert {r["section"] for r in rows} >= {"summary", "share", "taxonomy"}
    assert df.columns == ["section", "item", "n", "pct"]
