"""Site consolidation: fetched pages to one text per site (PAG1-4).

``html`` is the widest column in the system; only ``good_pages`` reads it,
and it leaves the plan as soon as the text is extracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmap.constants import MAX_GOOD_PAGES, MAX_TOTAL_CHARS, MIN_GOOD_CHARS, PAGE_PATHS
from marketmap.functions.text import html_text
from marketmap.operators.partitioning import spread


def page_plan(domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """PAG1: the 7 fixed paths per domain, in order (path_ord 1..7).

    The path list is a fixed 7-element literal, so the expansion is a local
    ``posexplode`` — no join and no shuffle.
    """
    paths = F.array(*[F.lit(p) for p in PAGE_PATHS])
    host = F.regexp_replace(F.col(domain_col), "^/+", "")
    base = F.regexp_replace(F.concat(F.lit("https://"), host), "/+$", "")
    d = domains.filter(F.col(domain_col).isNotNull() & (F.col(domain_col) != ""))
    return d.select(host.alias("host"), base.alias("_base"), F.posexplode(paths).alias("_i", "path")) \
        .select("host", (F.col("_i") + 1).alias("path_ord"), "path",
                F.concat("_base", "path").alias("url"))


def fetched_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """PAG2: planned pages that came back with status 200 and a non-empty body."""
    ok = pages.filter((F.col("status_code") == 200) & F.col("html").isNotNull()
                      & (F.col("html") != ""))
    return plan.select("host", "path_ord").join(ok, ["host", "path_ord"])


def page_texts(pages: DataFrame) -> DataFrame:
    """TXT9 on every fetched page with status 200 and a body, at the scan.

    Extracting before the join means the shuffle carries text, not HTML. The
    one-element generator keeps later filters on the text above it; a plain
    projection would be computed twice, for the filter and for the output.
    """
    ok = pages.filter((F.col("status_code") == 200) & F.col("html").isNotNull()
                      & (F.col("html") != ""))
    return spread(ok).select("host", "path_ord",
                             F.explode_outer(F.array(html_text("html"))).alias("text"))


def good_pages(fetched: DataFrame) -> DataFrame:
    """PAG3: page text of >= 500 characters, first 3 per host in path order.

    ``fetched`` carries ``html`` or an already extracted ``text``.
    ``row_number() <= 3`` is planned as a WindowGroupLimit, which trims each
    host to 3 rows before the window's shuffle.
    """
    text = F.col("text") if "text" in fetched.columns else html_text("html")
    t = fetched.select("host", "path_ord", text.alias("text")) \
        .filter(F.length("text") >= MIN_GOOD_CHARS)
    w = Window.partitionBy("host").orderBy("path_ord")
    return t.withColumn("_rn", F.row_number().over(w)) \
        .filter(F.col("_rn") <= MAX_GOOD_PAGES).drop("_rn")


def site_text(good: DataFrame) -> DataFrame:
    """PAG4: texts joined by a blank line; length before the cut; cut to 3000."""
    g = good.groupBy("host").agg(F.array_sort(F.collect_list(
        F.struct("path_ord", "text"))).alias("_p"))
    full = F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n")
    return g.select("host", F.length(full).alias("raw_length"),
                    F.substring(full, 1, MAX_TOTAL_CHARS).alias("text"))


def scrape(domains: DataFrame, pages: DataFrame, domain_col: str = "domain") -> DataFrame:
    """PAG1-4 end to end: one (host, raw_length, text) per domain with a usable page."""
    plan = page_plan(domains, domain_col).select("host", "path_ord")
    return site_text(good_pages(plan.join(page_texts(pages), ["host", "path_ord"])))
