"""Monitoring and reports: counts, shares, drift trigger, spend (MON1-9).

Every report starts from one partial aggregate of the state (or call log)
keyed by a low-cardinality column, so the big scan happens once and what
moves across the shuffle is a handful of rows per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmap.constants import (
    PRICE_GBP,
    REFRESH_EVERY,
    REFRESH_UNCLASSIFIED_THRESHOLD,
    REFRESH_WINDOW,
    UNCLASSIFIED,
)
from marketmap.operators.partitioning import attach_one_row, top_k

# Prices as integer hundred-thousandths of a pound so sums are exact.
_PRICE_SCALE = 100000


def _is_placed(c: Column) -> Column:
    return c.isNotNull() & (c != UNCLASSIFIED)


def sector_rollup(state: DataFrame) -> DataFrame:
    """One row per sector value (NULL included) with the counts every report needs."""
    return state.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("domain").isNotNull()).alias("n_domain"),
        F.count_if(F.col("services_description").isNotNull()).alias("n_services"),
        F.count_if(F.col("error_log").isNotNull()).alias("n_errored"),
    )


def summary_counts(state: DataFrame) -> DataFrame:
    """MON3: total, domain_found, services_extracted, classified, unclassified, errored."""
    return summary_from_rollup(sector_rollup(state))


def summary_from_rollup(r: DataFrame) -> DataFrame:
    def s(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return r.agg(
        s("n").alias("total"),
        s("n_domain").alias("domain_found"),
        s("n_services").alias("services_extracted"),
        s(F.when(_is_placed(F.col("sector")), F.col("n"))).alias("classified"),
        s(F.when(F.col("sector") == UNCLASSIFIED, F.col("n"))).alias("unclassified"),
        s("n_errored").alias("errored"),
    )


def sector_counts(state: DataFrame, limit: int = 20) -> DataFrame:
    """MON4: sectors by row count, descending, top ``limit``; NULL sector excluded."""
    return sector_counts_from_rollup(sector_rollup(state), limit)


def sector_counts_from_rollup(r: DataFrame, limit: int = 20) -> DataFrame:
    return (r.filter(F.col("sector").isNotNull())
            .select("sector", "n")
            .orderBy(F.col("n").desc(), F.col("sector"))
            .limit(limit))


def status_shares(summary: DataFrame) -> DataFrame:
    """MON5: unclassified percent (NULL when empty) and progress ratios over max(total, 1)."""
    denom = F.greatest(F.col("total"), F.lit(1)).cast("double")
    return summary.select(
        F.when(F.col("total") > 0, F.lit(100.0) * F.col("unclassified") / F.col("total"))
        .alias("unclassified_pct"),
        (F.col("domain_found") / denom).alias("domain_share"),
        (F.col("classified") / denom).alias("classified_share"),
        (F.col("unclassified") / denom).alias("unclassified_share"),
    )


def status_report(state: DataFrame, taxonomy_flat: DataFrame | None = None,
                  limit: int = 20, versions: DataFrame | None = None) -> DataFrame:
    """MON9: summary counts, top sectors, shares, latest version and sector total.

    The taxonomy line comes from the version table, not from the classified
    rows: number (NULL when there is none yet), creation time and trigger of
    the newest version (``taxonomy_created``, ``taxonomy_trigger``; the text
    is the item, '?' when it is not recorded).

    Long format ``(section, item, n, pct)``. The state is scanned and
    aggregated once (``sector_rollup``: one row per distinct sector value,
    bounded by the taxonomy). Totals and ranks are windows over that tiny
    frame, and every report line is exploded from it, so no branch rescans
    the state.
    """
    r = sector_rollup(state)
    everything = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy(
        F.col("sector").isNull(), F.col("n").desc(), F.col("sector"))
    sector = F.col("sector")
    x = r.select(
        "*",
        F.sum("n").over(everything).alias("total"),
        F.sum("n_domain").over(everything).alias("domain_found"),
        F.sum("n_services").over(everything).alias("services_extracted"),
        F.sum(F.when(_is_placed(sector), F.col("n")).otherwise(0)).over(everything)
        .alias("classified"),
        F.sum(F.when(sector == UNCLASSIFIED, F.col("n")).otherwise(0)).over(everything)
        .alias("unclassified"),
        F.sum("n_errored").over(everything).alias("errored"),
        F.row_number().over(ranked).alias("rk"))
    # The rk = 1 row carries the report-level lines; a one-row anchor keeps
    # them present (as zeros) when the state is empty.
    anchor = x.sparkSession.range(1).select(F.lit(1).alias("rk"))
    y = x.join(anchor, "rk", "full_outer")
    items = ["total", "domain_found", "services_extracted", "classified", "unclassified",
             "errored"]

    def line(section, item, n, pct):
        return F.struct(F.lit(section).alias("section"),
                        (F.lit(item) if isinstance(item, str) else item).alias("item"),
                        n.cast("bigint").alias("n"), pct.cast("double").alias("pct"))

    none = F.lit(None)
    total0 = F.coalesce(F.col("total"), F.lit(0))
    head = [line("summary", c, F.coalesce(F.col(c), F.lit(0)), none) for c in items]
    head.append(line("share", "unclassified_pct", none,
                     F.when(total0 > 0, F.lit(100.0) * F.col("unclassified") / total0)))
    sector_line = line("sector", sector, F.col("n"), F.lit(100.0) * F.col("n") / F.col("total"))
    is_head = F.coalesce(F.col("rk") == 1, F.lit(False))
    is_top = F.coalesce(sector.isNotNull() & (F.col("rk") <= limit), F.lit(False))
    cands = [(is_head, h) for h in head] + [(is_top, sector_line)]
    lines = F.transform(
        F.filter(F.array(*[F.struct(k.alias("keep"), v.alias("l")) for k, v in cands]),
                 lambda e: e["keep"]),
        lambda e: e["l"])
    out = y.select(F.explode(lines).alias("l")).select("l.*")
    if taxonomy_flat is not None:
        out = out.unionByName(
            taxonomy_flat.agg(F.countDistinct("sector_pos").cast("bigint").alias("n"))
            .select(F.lit("taxonomy").alias("section"), F.lit("sectors").alias("item"), "n",
                    F.lit(None).cast("double").alias("pct")))
    if versions is not None:
        newest = versions.agg(
            F.max("version_id").alias("v"),
            F.max_by(F.struct(F.substring(F.col("created_at").cast("string"), 1, 19).alias("at"),
                              "refresh_trigger"), "version_id").alias("of"))
        lines = F.array(line("taxonomy", "latest_version", F.col("v"), none),
                        *[line(f"taxonomy_{name}", F.coalesce(c, F.lit("?")), F.col("v"), none)
                          for name, c in (("created", F.col("of.at")),
                                          ("trigger", F.col("of.refresh_trigger")))])
        out = out.unionByName(newest.select(F.explode(
            F.filter(lines, lambda x: F.col("v").isNotNull() | (x["section"] == "taxonomy")))
            .alias("l")).select("l.*"))
    return out


def rolling_unclassified(state: DataFrame, window: int = REFRESH_WINDOW) -> DataFrame:
    """MON1: unclassified and total among the last ``window`` rows with a sector.

    An exact top-``window`` (``top_k``): per-partition top-k, grouped
    pre-reduction when there are many partitions, one small final merge.
    """
    last = top_k(state.filter(F.col("sector").isNotNull())
                 .select("company_number", "sector", "processed_at"),
                 [F.col("processed_at").desc_nulls_last(), F.col("company_number")], window)
    return last.agg(
        F.count_if(F.col("sector") == UNCLASSIFIED).alias("unclassified"),
        F.count(F.lit(1)).alias("total"),
    )


def refresh_trigger(rolling: DataFrame, rows_since_refresh: DataFrame | Column | int,
                    every: int = REFRESH_EVERY, window: int = REFRESH_WINDOW,
                    threshold: float = REFRESH_UNCLASSIFIED_THRESHOLD) -> DataFrame:
    """MON2: 'scheduled', else 'unclassified_threshold' (strictly above), else NULL.

    ``rows_since_refresh`` is a count, a one-row DataFrame holding it in
    column ``rows_since_refresh`` (kept lazy: no driver round trip), or a column
    of ``rolling``, judged row by row; other columns of ``rolling`` are kept.
    """
    others = [c for c in rolling.columns if c not in ("unclassified", "total", "rows_since_refresh")]
    if isinstance(rows_since_refresh, DataFrame):
        rolling = attach_one_row(rolling, rows_since_refresh.select("rows_since_refresh"))
        since = F.col("rows_since_refresh")
    else:
        since = F.lit(rows_since_refresh)  # a column stays one
    rate = F.col("unclassified") / F.greatest(F.col("total"), F.lit(1)).cast("double")
    return rolling.select(
        *others, "unclassified", "total", since.cast("bigint").alias("rows_since_refresh"),
        F.when(since >= every, F.lit("scheduled"))
        .when((F.col("total") >= window) & (rate > threshold), F.lit("unclassified_threshold"))
        .otherwise(F.lit(None).cast("string")).alias("trigger"),
    )


def price_table(spark) -> DataFrame:
    """Fixed price list, as integer hundred-thousandths of a pound."""
    return spark.createDataFrame(
        [(s, int(round(p * _PRICE_SCALE))) for s, p in PRICE_GBP],
        "service string, unit_price_e5 bigint")


def spend(calls: DataFrame) -> DataFrame:
    """MON6: calls and GBP by priced service, plus a 'total' line (grouping set)."""
    prices = F.broadcast(price_table(calls.sparkSession))
    per = calls.groupBy("service").agg(F.count(F.lit(1)).alias("calls"))
    priced = per.join(prices, "service")
    out = priced.rollup("service").agg(
        F.sum("calls").cast("bigint").alias("calls"),
        F.sum(F.col("calls") * F.col("unit_price_e5")).alias("_e5"))
    return out.select(F.coalesce(F.col("service"), F.lit("total")).alias("service"), "calls",
                      (F.col("_e5") / F.lit(float(_PRICE_SCALE))).alias("gbp"))


def run_counters(calls: DataFrame) -> DataFrame:
    """MON7: companies processed, companies with a guessed or searched domain, failed calls."""
    return calls.agg(
        F.countDistinct("company_id").alias("processed"),
        F.countDistinct(F.when(F.col("service").isin("guess", "search")
                               & (F.col("outcome") == "placed"),
                               F.col("company_id"))).alias("domains_found"),
        F.count_if(F.col("service") == "failed").alias("errors"),
    )


def time_per_company(calls: DataFrame) -> DataFrame:
    """MON8: elapsed seconds over the call log divided by companies processed."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    agg = calls.agg((F.max(us) - F.min(us)).alias("_us"),
                    F.countDistinct("company_id").alias("companies"))
    elapsed = F.col("_us") / F.lit(1e6)
    return agg.select(elapsed.alias("elapsed_s"), "companies",
                      F.when(F.col("companies") > 0, elapsed / F.col("companies"))
                      .alias("sec_per_company"))
