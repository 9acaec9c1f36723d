"""Named checks: each is a Spark job over the fixture views plus, where SQL
can say the same thing, the oracle text DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketmap.plans.fixtures import Fixtures, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views=()):
    """Register ``fn(fx: Fixtures) -> DataFrame`` under ``name``."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers checks."""
    from marketmap.plans import checks  # noqa: F401
