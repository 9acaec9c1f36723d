"""Retry of errored rows (RTY1-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmap.constants import INSUFFICIENT_DATA, UNCLASSIFIED
from marketmap.sources.state import as_state_row


def errored(state: DataFrame) -> DataFrame:
    """RTY1: rows with an error logged."""
    return as_state_row(state).filter(F.col("error_log").isNotNull()) \
        .select("company_number", "company_name", "postcode", "error_log")


def retry_outcome(before: DataFrame, after: DataFrame) -> DataFrame:
    """RTY3: what a rerun made of the rows that were errored, from the state before and after it.

    One row for each row of ``before`` with an error: ``was_error``, ``now_error``, whether the domain changed,
    whether the description is usable now, the sector before and after, and ``outcome``:
    ``errored`` (an error again), else ``placed`` / ``unclassified`` (classified by the rerun), else ``described``
    (usable description, no sector), else ``insufficient`` (described as having no data), else ``empty``.
    A row that ``after`` does not hold is ``missing``.
    """
    was = as_state_row(before).filter(F.col("error_log").isNotNull()).select(
        "company_number", "company_name", F.col("error_log").alias("was_error"),
        F.col("domain").alias("_domain"), F.col("sector").alias("was_sector"))
    now = as_state_row(after).select(
        "company_number", F.col("error_log").alias("now_error"), F.col("domain").alias("_now_domain"),
        F.col("services_description").alias("_text"), F.col("sector").alias("now_sector"),
        F.lit(True).alias("_there"))
    text, sector = F.coalesce(F.col("_text"), F.lit("")), F.col("now_sector")
    usable = (text != "") & (text != INSUFFICIENT_DATA)
    outcome = (F.when(F.col("_there").isNull(), "missing")
               .when(F.col("now_error").isNotNull(), "errored")
               .when(sector == UNCLASSIFIED, "unclassified")
               .when(sector.isNotNull(), "placed")
               .when(usable, "described")
               .when(text == INSUFFICIENT_DATA, "insufficient")
               .otherwise("empty"))
    return was.join(now, "company_number", "left").select(
        "company_number", "company_name", "was_error", "now_error",
        (~F.col("_domain").eqNullSafe(F.col("_now_domain"))).alias("domain_changed"),
        usable.alias("usable"), "was_sector", "now_sector", outcome.alias("outcome"))


def retry_counts(outcomes: DataFrame) -> DataFrame:
    """RTY3: the summary of a rerun, rows by outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
