"""Taxonomy refresh: gap set, context sample, accept gate, reclassify cohort (RFR1-6).

Driver-side decisions here are one-row results (is there a version? did the
gate pass?); everything else stays a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmap.constants import CONTEXT_SAMPLE_N, SAMPLE_SEED, UNCLASSIFIED
from marketmap.operators.partitioning import attach_one_row, top_k
from marketmap.sources.state import as_state_row, clear_unclassified


def _at_version(state: DataFrame, version: DataFrame) -> DataFrame:
    """Rows whose taxonomy_version_id equals the one-row ``version`` frame's value."""
    v = version.select(F.col("version_id").alias("_v"))
    return state.join(F.broadcast(v), F.col("taxonomy_version_id") == F.col("_v")).drop("_v")


def gap_rows(state: DataFrame, version: DataFrame) -> DataFrame:
    """RFR1: UNCLASSIFIED rows at ``version``."""
    return _at_version(state, version).filter(F.col("sector") == UNCLASSIFIED) \
        .select("company_number", "company_name", "services_description")


def context_sample(state: DataFrame, version: DataFrame, n: int = CONTEXT_SAMPLE_N,
                   seed: int = SAMPLE_SEED) -> DataFrame:
    """RFR2: ``n`` placed rows at ``version``, in a seeded hash order (repeatable).

    An exact top-n (``top_k``); column ``_h`` is the order key.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("company_number")))
    s = as_state_row(state) if "sub_sector" not in state.columns else state
    placed = _at_version(s, version).filter(
        F.col("sector").isNotNull() & (F.col("sector") != UNCLASSIFIED))
    rows = placed.select("company_number", "company_name", "services_description", "sector",
                         "sub_sector", h.alias("_h"))
    return top_k(rows, [F.col("_h"), F.col("company_number")], n)


def refresh_size(gap: DataFrame, context: DataFrame) -> DataFrame:
    """RFR3: gap rows + context rows (the original's own 'approximate' total)."""
    g = gap.agg(F.count(F.lit(1)).alias("n_gap"))
    c = context.agg(F.count(F.lit(1)).alias("n_context"))
    return attach_one_row(g, c).withColumn("n_total", F.col("n_gap") + F.col("n_context"))


def refresh_decision(facts: DataFrame, force: bool = False, dry_run: bool = False,
                     trigger: str = "manual") -> DataFrame:
    """RFR4: the accept gate over one row of facts.

    ``facts`` columns: latest_version (NULL = none), has_taxonomy, n_gap,
    n_new_sectors (0 = empty result), n_errors (TAX4 on the new taxonomy),
    n_lost (TAX5 names lost). Reasons, in order: no version; no file;
    manual with an empty gap; empty result; invalid unless forced; sector
    lost unless forced; dry run.
    """
    reason = (F.when(F.col("latest_version").isNull(), "no current taxonomy in DB")
              .when(~F.col("has_taxonomy"), "taxonomy file not found")
              .when((F.lit(trigger) == "manual") & (F.col("n_gap") == 0),
                    "no unclassified companies")
              .when(F.col("n_new_sectors") == 0, "refresh returned nothing")
              .when((F.col("n_errors") > 0) & ~F.lit(force),
                    "validation failed (use --force to accept anyway)")
              .when((F.col("n_lost") > 0) & ~F.lit(force), "sector rename blocked")
              .when(F.lit(dry_run), "dry-run"))
    return facts.select(
        F.lit(trigger).alias("trigger"), F.lit(force).alias("force"),
        F.lit(dry_run).alias("dry_run"), reason.isNull().alias("accepted"),
        reason.alias("reason"),
        F.when(reason.isNull(), (F.col("latest_version") + 1).cast("int")).alias("new_version_id"))


def cleared_cohort(state: DataFrame, version: DataFrame) -> DataFrame:
    """RFR5: blank the gap rows at ``version``; the cohort is every row with
    sector and version NULL and a description (also never-classified rows)."""
    v = version.select(F.col("version_id").alias("_v"))
    s = attach_one_row(as_state_row(state), v)
    cleared = clear_unclassified(s, F.col("_v")).drop("_v")
    return cleared.filter(F.col("sector").isNull() & F.col("taxonomy_version_id").isNull()
                          & F.col("services_description").isNotNull())


def outcome_counts(classified: DataFrame) -> DataFrame:
    """RFR6: now placed vs still unclassified (a NULL sector counts as unclassified)."""
    placed = F.coalesce(F.col("sector"), F.lit(UNCLASSIFIED)) != UNCLASSIFIED
    return classified.groupBy(F.when(placed, "placed").otherwise("unclassified")
                              .alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
