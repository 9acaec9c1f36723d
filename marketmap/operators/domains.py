"""Entity resolution of a company to its web domain (DOM1-9).

Cheap first: a guessed ``<slug>.<tld>`` that answered the probe wins;
otherwise the first search hit (in query, rank order) whose bare label
shares enough name tokens. Probe and search results arrive as tables.

Plan shape: hits are joined to companies on the company key (one shuffle
of each side), and the per-company pick reuses that hash partitioning, so
the aggregate adds no exchange. In the cascade only hits of companies
without a guess pass that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmap.constants import TLD_ORDER
from marketmap.functions import text as X


def guess_candidates(companies: DataFrame) -> DataFrame:
    """DOM1: slug x (co.uk, com, uk, org.uk) in preference order; none if slug < 3."""
    tlds = F.array(*[F.lit(t) for t in TLD_ORDER])
    s = companies.select("company_number", X.slug("company_name").alias("_slug")) \
        .filter(F.length("_slug") >= 3)
    return s.select("company_number", F.posexplode(tlds).alias("pref", "_tld"), "_slug") \
        .select("company_number", "pref",
                F.concat("_slug", F.lit("."), "_tld").alias("candidate"))


def guess_domain(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """DOM2: best reachable candidate (probe status in [200, 400)), HIGH, 'guess'."""
    ok = probes.filter((F.col("status_code") >= 200) & (F.col("status_code") < 400)) \
        .select(F.col("host").alias("candidate")).distinct()
    hit = candidates.join(ok, "candidate")
    return hit.groupBy("company_number").agg(
        F.min_by("candidate", "pref").alias("domain")) \
        .select("company_number", "domain", F.lit("HIGH").alias("domain_confidence"),
                F.lit("guess").alias("domain_method"))


def search_queries(companies: DataFrame) -> DataFrame:
    """DOM3: up to three query texts; only the bare quoted name without a postcode sector.

    Query numbers are fixed slots (1, 2, 3) so hits can be matched to the
    query that produced them. No tokens in the name: no queries at all.
    """
    clean = X.clean_name("company_name")
    pc = X.postcode_sector("postcode")
    q = F.array(
        F.when(pc.isNotNull(), F.struct(F.lit(1).alias("query_no"),
                                        F.format_string('"%s" %s', clean, pc).alias("query"))),
        F.struct(F.lit(2).alias("query_no"), F.format_string('"%s"', clean).alias("query")),
        F.when(pc.isNotNull(), F.struct(F.lit(3).alias("query_no"),
                                        F.format_string("%s %s", clean, pc).alias("query"))))
    s = companies.filter(F.size(X.name_tokens("company_name")) > 0) \
        .select("company_number", F.explode(F.array_compact(q)).alias("_q"))
    return s.select("company_number", "_q.query_no", "_q.query")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """DOM4: a link counts once per company, at its first (query_no, rank); '' dropped."""
    w = Window.partitionBy("company_number", "link").orderBy("query_no", "rank")
    return hits.filter(F.col("link").isNotNull() & (F.col("link") != "")) \
        .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def drop_directories(hits: DataFrame) -> DataFrame:
    """DOM5: remove hits on directory / aggregator hosts."""
    return hits.filter(~X.is_directory_host(X.host("link")))


def score_hits(hits: DataFrame, companies: DataFrame) -> DataFrame:
    """DOM6-7: token-overlap score of the bare label and its confidence band."""
    tok = companies.select("company_number", X.name_tokens("company_name").alias("_tokens"))
    j = hits.join(tok, "company_number")
    bare = X.bare_label("link")
    score = F.when(bare == "", F.lit(0)).otherwise(
        F.size(F.filter("_tokens", lambda t: F.instr(bare, t) > 0)))
    return j.withColumn("bare", bare).withColumn("score", score) \
        .withColumn("band", confidence_band(F.col("score"))).drop("_tokens")


def confidence_band(score) -> F.Column:
    """DOM7: >= 6 HIGH, >= 3 MEDIUM, else NULL (rejected)."""
    return F.when(score >= 6, F.lit("HIGH")).when(score >= 3, F.lit("MEDIUM")) \
        .otherwise(F.lit(None).cast("string"))


def _name_facts(companies: DataFrame) -> DataFrame:
    """Name tokens and the postcode flag of each company, what the search cascade needs of it."""
    return companies.select("company_number", X.name_tokens("company_name").alias("_tokens"),
                            X.postcode_sector("postcode").isNotNull().alias("_pc"))


def _links(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("link").isNotNull() & (F.col("link") != "")) \
        .select("company_number", "query_no", "rank", "link")


def _first_accepted(joined: DataFrame, *keep: F.Column) -> DataFrame:
    """Per company the first accepted hit as ``_b`` (NULL without one), with the aggregates ``keep``.

    ``joined`` holds hits beside the facts of their company; a row without a hit is never accepted. Accepted = a
    query the plan (DOM3) issues, not a directory, band not NULL, non-empty host.
    """
    planned = (F.size("_tokens") > 0) & (
        (F.col("query_no") == 2) | (F.col("_pc") & F.col("query_no").isin(1, 3)))
    # The host is parsed once per hit; label, directory test and the stored host all derive from it.
    j = joined.withColumn("_h", F.when(planned, X.host("link"))) \
        .withColumn("_host", X.drop_www(X.url_host(F.col("link"))))
    bare = F.substring_index(F.col("_h"), ".", 1)
    score = F.when(bare == "", F.lit(0)).otherwise(
        F.size(F.filter("_tokens", lambda t: F.instr(bare, t) > 0)))
    j = j.withColumn("band", F.when(~X.is_directory_host(F.col("_h")), confidence_band(score)))
    accepted = F.col("band").isNotNull() & (F.col("_host") != "")
    return j.groupBy("company_number").agg(
        F.min_by(F.struct(F.col("_host").alias("domain"), F.col("band").alias("domain_confidence")),
                 F.when(accepted, F.struct("query_no", "rank"))).alias("_b"), *keep)


def search_domain(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """DOM8: first accepted hit by (query_no, rank); method 'serper'.

    One join of hits to companies carries the name tokens and the postcode flag; the per-company pick reuses its
    partitioning. Link de-duplication cannot change which hit is first, so it is skipped here.
    """
    best = _first_accepted(_links(hits).join(_name_facts(companies), "company_number"))
    return best.filter(F.col("_b").isNotNull()) \
        .select("company_number", "_b.domain", "_b.domain_confidence", F.lit("serper").alias("domain_method"))


def resolve_domains(companies: DataFrame, probes: DataFrame, hits: DataFrame) -> DataFrame:
    """DOM9: guess first, else search, else NULL — one row per company.

    The guesses are joined to the companies first; the join with the hits lets through only those of companies
    without a guess, so no other hit is parsed or scored. Both joins and the pick share one partitioning.
    """
    cols = ["domain", "domain_confidence", "domain_method"]
    g = guess_domain(guess_candidates(companies), probes).select("company_number", F.struct(*cols).alias("_g"))
    c = _name_facts(companies).join(g, "company_number", "left").alias("c")
    h = _links(hits).alias("h")
    j = c.join(h, (F.col("c.company_number") == F.col("h.company_number")) & F.col("c._g").isNull(), "left") \
        .select("c.*", "h.query_no", "h.rank", "h.link")
    best = _first_accepted(j, F.first("_g").alias("_g"))
    found = F.struct("_b.domain", "_b.domain_confidence", F.lit("serper").alias("domain_method"))
    pick = F.coalesce("_g", F.when(F.col("_b").isNotNull(), found))
    return best.select("company_number", pick.alias("_p")).select("company_number", *[F.col("_p")[k].alias(k) for k in cols])
