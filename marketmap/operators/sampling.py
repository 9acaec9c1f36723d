"""Stratified, repeatable sampling (SMP1-4).

Quota per postcode area = min(half-even round(n x share), stratum size);
rows are ranked inside their stratum by md5(seed:key); the quota rows come
first and the rest of the sample is topped up (or trimmed) in hash order, so
the result has exactly min(n, rows) rows.

Scale: stratum counts are a partial aggregate over at most 703 areas (one
or two letters, plus '_NONE_'), broadcast back. The in-stratum rank keeps
only ranks <= n, which Spark plans as a WindowGroupLimit, so a stratum
holding a third of the input still ships at most n rows per map task. Quota
rows and top-up rows both come from the ranked rows, so the input is not joined
with itself; the final pick is an exact top-n (``top_k``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmap.constants import NONE_AREA, SAMPLE_SEED, SAMPLE_SIZE
from marketmap.functions.text import postcode_area
from marketmap.operators.partitioning import attach_one_row, top_k


def _hash(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("company_number")))


def stratified_sample(companies: DataFrame, n: int = SAMPLE_SIZE,
                      seed: int = SAMPLE_SEED) -> DataFrame:
    """SMP1-3: exactly min(n, rows) companies, proportional to postcode area."""
    d = companies.withColumn("area", F.coalesce(postcode_area("postcode"), F.lit(NONE_AREA))) \
        .withColumn("_h", _hash(seed))
    counts = d.groupBy("area").agg(F.count(F.lit(1)).alias("_cnt"))
    total = counts.agg(F.sum("_cnt").alias("_total"))
    quota = attach_one_row(counts, total).select(
        "area", F.least(F.bround(F.lit(float(n)) * (F.col("_cnt") / F.col("_total")), 0),
                        F.col("_cnt")).cast("bigint").alias("_quota"))
    w = Window.partitionBy("area").orderBy("_h", "company_number")
    # A row that is picked has an in-stratum rank of n at most: all before it in its stratum are picked too.
    ranked = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n) \
        .join(F.broadcast(quota), "area").withColumn("_in", F.col("_rn") <= F.col("_quota"))
    picked = top_k(ranked, [F.col("_in").desc(), F.col("_h"), F.col("company_number")], n)
    return picked.select(*[c for c in d.columns if c != "_h"])


def simple_sample(companies: DataFrame, n: int = SAMPLE_SIZE,
                  seed: int = SAMPLE_SEED) -> DataFrame:
    """SMP3: plain repeatable sample (whole input when n >= rows)."""
    d = companies.withColumn("_h", _hash(seed))
    return top_k(d, [F.col("_h"), F.col("company_number")], n).drop("_h")


def sticky_sample(companies: DataFrame, state: DataFrame, n: int = SAMPLE_SIZE,
                  seed: int = SAMPLE_SEED) -> DataFrame:
    """SMP4: reuse the flagged sample if any row is flagged, else draw a new one.

    The branch is a one-row decision (is anything flagged?).
    """
    flagged = state.filter(F.col("sampled_for_discovery") == 1).select("company_number")
    if flagged.limit(1).count() > 0:
        return companies.join(flagged, "company_number", "left_semi")
    return stratified_sample(companies, n, seed)
