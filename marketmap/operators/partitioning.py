"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Largest side we broadcast (rows); above it the join is left to the planner.
BROADCAST_MAX_ROWS = 2_000_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count proves it small (a one-row decision);
    otherwise leave the strategy to the planner and AQE."""
    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over all cores before CPU-heavy per-row work, but only
    when the input has fewer partitions than that (a few large files). A large
    scan already has far more splits than cores and is left untouched."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


# Groups whose first rows top_k finds on their own before the final merge.
TOP_K_GROUPS = 64


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """Exact first ``k`` rows of ``df`` in ``order`` (columns must give a total order).

    ``orderBy().limit(k)`` alone merges k rows of every partition in one task,
    too much for 100k partitions. Here partitions fall into a fixed number of
    groups first and each group keeps its own first k with
    ``row_number() <= k`` -- a WindowGroupLimit that trims every map task before
    the shuffle -- so the final merge sees at most TOP_K_GROUPS * k rows. Any
    global top-k row is in its group's top-k, so the result is exact.
    """
    w = Window.partitionBy("_g").orderBy(*order)
    pre = df.withColumn("_g", F.spark_partition_id() % TOP_K_GROUPS) \
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_g", "_r")
    return pre.orderBy(*order).limit(k)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row of ``df``.

    ``one_row`` must be a global aggregate or a literal row, so the join is
    a broadcast of a single row: it emits exactly ``df``'s rows, never pairs.
    """
    return df.crossJoin(F.broadcast(one_row))
