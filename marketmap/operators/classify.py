"""Classification (CLS1-10).

The per-company model call is re-aimed as a lexical scorer (CLS4): a sparse
product of company terms and taxonomy-leaf terms. The taxonomy side is
small and size-checked before it is broadcast; the company side is
hash-partitioned once by company_number, and the per-(company, leaf) sums
and the per-company top-1 reuse that partitioning (no further exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmap.constants import (
    CARRY_OVER,
    CHECKPOINT_EVERY,
    CLASSIFY_MISSING_ERROR,
    INSUFFICIENT_DATA,
    NO_SERVICES_RATIONALE,
    UNCLASSIFIED,
)
from marketmap.functions.text import json_kind
from marketmap.operators.partitioning import attach_one_row, checked_broadcast
from marketmap.operators.sequence import dense_index
from marketmap.operators.services import parse_response
from marketmap.operators.taxonomy import first_sector_pos, sub_sectors, term_array
from marketmap.sources.export import py_json_text, py_repr_text
from marketmap.sources.state import as_state_row

def _no_data(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "") | (F.col(c) == INSUFFICIENT_DATA)


def pending(companies: DataFrame, state: DataFrame, limit: int | None = None) -> DataFrame:
    """CLS1: input rows not yet classified or errored; optional ``limit`` in input order."""
    done = state.filter(F.col("sector").isNotNull() | F.col("error_log").isNotNull()) \
        .select("company_number")
    todo = companies.join(done, "company_number", "left_anti")
    if limit:
        todo = todo.orderBy("input_seq", "company_number").limit(limit)
    return todo


def needs_services(companies: DataFrame, state: DataFrame) -> DataFrame:
    """CLS2: rows whose stages must run first (no row, no description, or the sentinel)."""
    ex = state.select("company_number", F.lit(True).alias("_has"),
                      F.col("services_description").alias("_desc"))
    j = companies.join(ex, "company_number", "left")
    need = F.col("_has").isNull() | F.col("_desc").isNull() | (F.col("_desc") == "") | \
        (F.col("_desc") == INSUFFICIENT_DATA)
    return j.select(*companies.columns, need.alias("needs_services"))


def no_data_rule(df: DataFrame, desc: str = "services_description") -> DataFrame:
    """CLS3: empty or sentinel description -> UNCLASSIFIED, LOW, 'no services data'."""
    return df.filter(_no_data(desc)).select(
        "company_number", F.lit(UNCLASSIFIED).alias("sector"),
        F.lit(None).cast("string").alias("sub_sector"), F.lit("LOW").alias("confidence"),
        F.lit(NO_SERVICES_RATIONALE).alias("rationale"),
        F.lit(None).cast("array<string>").alias("keywords"))


def leaf_terms(flat: DataFrame) -> DataFrame:
    """Distinct terms of each leaf (sector, sub-sector names and descriptions) with IDF weight."""
    def opt(c):
        return F.coalesce(F.col(c), F.lit("")) if c in flat.columns else F.lit("")

    leaves = flat.filter(F.col("sub_pos").isNotNull()).select(
        "sector_pos", "sub_pos", "sector", "sub_sector",
        term_array(F.concat_ws(" ", opt("sector"), opt("sub_sector"), opt("sector_description"),
                               opt("sub_description"))).alias("_t"))
    n = leaves.agg(F.count(F.lit(1)).alias("_N"))
    lt = leaves.select("sector_pos", "sub_pos", "sector", "sub_sector",
                       F.explode("_t").alias("term"))
    df = lt.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    return attach_one_row(lt.join(df, "term"), n).select(
        "term", "sector_pos", "sub_pos", "sector", "sub_sector",
        (F.log((F.col("_N") + 1) / (F.col("_df") + 1)) + 1).alias("weight"))


def _confidence(shared: Column) -> Column:
    return F.when(shared >= 3, "HIGH").when(shared == 2, "MEDIUM").otherwise("LOW")


def classify_lexical(companies: DataFrame, flat: DataFrame,
                     desc: str = "services_description",
                     specialisms: str | None = "specialisms",
                     terms: DataFrame | None = None) -> DataFrame:
    """CLS3 + CLS4: one sector and sub-sector per company with confidence,
    rationale and keywords.

    score = sum of IDF weights of shared terms (rounded to 6 places); top-1
    by score, shared count, sector_pos, sub_pos. No shared term: UNCLASSIFIED
    ('no taxonomy terms matched'); no usable description: CLS3.

    One pipeline: companies are hash-partitioned by key once; terms are
    matched against the size-checked broadcast leaf table with a left join
    (so rows without a match stay in the flow); the per-(company, leaf) sums
    and the per-company pick run in that same partitioning. ``terms`` may be
    a precomputed ``leaf_terms(flat)`` (e.g. shared by micro-batches).
    """
    spec = F.array_join(F.col(specialisms), " ") \
        if specialisms and specialisms in companies.columns else F.lit("")
    nodata = _no_data(desc)
    base = companies.select(
        "company_number", nodata.alias("_nodata"),
        F.when(~nodata, term_array(F.concat_ws(" ", F.col(desc), spec))).alias("_t"))
    ct = base.repartition("company_number") \
        .select("company_number", "_nodata", F.explode_outer("_t").alias("term"))
    terms = checked_broadcast(leaf_terms(flat) if terms is None else terms)
    m = ct.join(terms, "term", "left")
    hit = F.col("weight").isNotNull()
    per = m.groupBy("company_number", "sector_pos", "sub_pos").agg(
        F.first("_nodata").alias("_nodata"),
        F.first("sector").alias("sector"), F.first("sub_sector").alias("sub_sector"),
        F.round(F.sum("weight"), 6).alias("score"), F.count("weight").alias("shared"),
        F.slice(F.array_sort(F.collect_list(F.when(hit, F.struct(
            (-F.col("weight")).alias("w"), "term")))), 1, 3).alias("_kw"))
    w = Window.partitionBy("company_number").orderBy(
        F.col("score").desc_nulls_last(), F.col("shared").desc(), "sector_pos", "sub_pos")
    best = per.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    kw = F.transform("_kw", lambda x: x["term"])
    matched = F.col("sector_pos").isNotNull()
    nd = F.col("_nodata")

    def pick(no_data, unmatched, placed):
        return F.when(nd, no_data).when(~matched, unmatched).otherwise(placed)

    none_s = F.lit(None).cast("string")
    return best.select(
        "company_number",
        pick(F.lit(UNCLASSIFIED), F.lit(UNCLASSIFIED), F.col("sector")).alias("sector"),
        pick(none_s, none_s, F.col("sub_sector")).alias("sub_sector"),
        pick(F.lit("LOW"), F.lit("LOW"), _confidence(F.col("shared"))).alias("confidence"),
        pick(F.lit(NO_SERVICES_RATIONALE), F.lit("no taxonomy terms matched"),
             F.format_string("matched %d taxonomy terms: %s", F.col("shared"),
                             F.array_join(kw, ", "))).alias("rationale"),
        pick(F.lit(None).cast("array<string>"), F.array().cast("array<string>"), kw)
        .alias("keywords"),
        pick(F.lit(None).cast("double"), F.lit(0.0), F.col("score")).alias("score"),
        pick(F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), F.col("shared")).alias("shared"))


def missing_responses(companies: DataFrame, responses: DataFrame) -> DataFrame:
    """CLS5: companies without a model response get the error and a NULL sector."""
    r = responses.select("company_number", "sector", F.lit(True).alias("_got"))
    j = companies.select("company_number").join(r, "company_number", "left")
    return j.select("company_number",
                    F.when(F.col("_got"), F.col("sector")).alias("sector"),
                    F.when(F.col("_got").isNull(), F.lit(CLASSIFY_MISSING_ERROR))
                    .alias("error_log"))


def validate_proposals(proposals: DataFrame, flat: DataFrame,
                       conf: str = "confidence") -> DataFrame:
    """CLS6: names must be verbatim. UNCLASSIFIED keeps its confidence and drops the
    sub-sector; an unknown sector, or an unknown or NULL sub-sector of a known one,
    becomes UNCLASSIFIED / NULL / LOW. Both lookups are taxonomy-sized and
    broadcast after a size check."""
    names = checked_broadcast(first_sector_pos(flat).select("sector", F.lit(True).alias("_known")))
    pairs = checked_broadcast(sub_sectors(flat).select("sector", "sub_sector")
                              .distinct().withColumn("_pair", F.lit(True)))
    j = proposals.join(names, "sector", "left").join(pairs, ["sector", "sub_sector"], "left")
    is_unc = F.col("sector") == UNCLASSIFIED
    bad = F.col("_known").isNull() | F.col("_pair").isNull()
    others = [c for c in proposals.columns if c not in ("sector", "sub_sector", conf)]
    return j.select(
        *others,
        F.when(is_unc, F.col("sector")).when(bad, F.lit(UNCLASSIFIED))
        .otherwise(F.col("sector")).alias("sector"),
        F.when(is_unc | bad, F.lit(None).cast("string")).otherwise(F.col("sub_sector"))
        .alias("sub_sector"),
        F.when(is_unc.eqNullSafe(True), F.col(conf)).when(bad, F.lit("LOW"))
        .otherwise(F.col(conf)).alias(conf))


def keywords_json(v: Column) -> Column:
    """CLS7: a list as Python's json.dumps writes it, anything else as str(); missing -> '[]'.

    Members may be of any kind. VARIANT holds the keys of an object in
    alphabetical order and numbers without trailing zeros, so both print so.
    """
    k = json_kind(v)
    return (F.when(v.isNull(), F.lit("[]"))
            .when(k == "array", py_json_text(F.to_json(v)))
            .when(k == "string", F.variant_get(v, "$", "string"))
            .otherwise(py_repr_text(F.to_json(v))))


def response_keywords(df: DataFrame, raw: str = "raw", field: str = "specialisms") -> DataFrame:
    """CLS7 over raw responses: the JSON text stored for a list field of each object."""
    v = parse_response(raw)
    d = df.withColumn("_v", v).filter(json_kind(F.col("_v")) == "object")
    return d.select("company_number", keywords_json(
        F.variant_get(F.col("_v"), f"$.{field}", "variant")).alias("keywords_json"))


def carry_over(patches: DataFrame, existing: DataFrame) -> DataFrame:
    """CLS8: a classification patch keeps the 7 stage columns of the earlier row."""
    ex = as_state_row(existing).select("company_number", *CARRY_OVER)
    keep = [c for c in patches.columns if c not in CARRY_OVER]
    return patches.select(*keep).join(ex, "company_number")


def chunk_stats(pending_rows: DataFrame, every: int = CHECKPOINT_EVERY,
                order: str = "input_seq") -> DataFrame:
    """CLS9: chunks of ``every`` pending rows in input order, numbered densely."""
    idx = dense_index(pending_rows, [order, "company_number"], "_seq")
    c = idx.withColumn("chunk_no", F.floor((F.col("_seq") - 1) / every).cast("bigint"))
    return c.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n"),
                                     F.min("_seq").alias("first_seq"),
                                     F.max("_seq").alias("last_seq"))


def reclassify(cohort: DataFrame, flat: DataFrame) -> DataFrame:
    """CLS10: classify a cohort against a (new) taxonomy and verify the names."""
    c = classify_lexical(cohort, flat)
    return validate_proposals(c, flat)

