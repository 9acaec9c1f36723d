"""Taxonomy operators (TAX1-12).

A taxonomy travels in flat form: one row per (sector_pos, sub_pos) with
``sector``, ``sub_sector`` and optional descriptions; a sector without
sub-sectors has ``sub_pos`` NULL. Rules run as DataFrame jobs over that
form, so a taxonomy version table with many versions validates in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmap.constants import (
    BANNED_WORDS,
    CLUSTER_BATCH,
    EXPECTED_SECTORS,
    INSUFFICIENT_DATA,
    MAX_SUB_SECTORS,
    TOKEN_STOP_WORDS,
    UNCLASSIFIED,
)
from marketmap.functions.text import json_kind
from marketmap.operators.partitioning import attach_one_row, checked_broadcast
from marketmap.operators.sequence import dense_index

# Broadcast sides in this module are per-sector tables of one taxonomy
# document (a handful of rows: 20 sectors once valid) or one-row frames;
# leaf-level tables go through ``checked_broadcast``.


def _opt(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


# ---- TAX1-3 ----

def flatten(doc: DataFrame) -> DataFrame:
    """TAX1: document rows (``sectors`` array) to the flat form, positions 0-based."""
    keep = [c for c in doc.columns if c != "sectors"]
    s = doc.select(*keep, F.posexplode("sectors").alias("sector_pos", "_s"))
    f = s.select(*keep, F.col("sector_pos").cast("int"),
                 F.col("_s.name").alias("sector"),
                 F.col("_s.description").alias("sector_description"),
                 F.posexplode_outer("_s.sub_sectors").alias("sub_pos", "_u"))
    return f.select(*keep, "sector_pos", "sector", "sector_description",
                    F.col("sub_pos").cast("int"), F.col("_u.name").alias("sub_sector"),
                    F.col("_u.description").alias("sub_description"))


def sector_names(flat: DataFrame) -> DataFrame:
    """TAX2: (sector_pos, sector) in order."""
    return flat.select("sector_pos", "sector").distinct().orderBy("sector_pos")


def first_sector_pos(flat: DataFrame) -> DataFrame:
    """Position of the first sector carrying each name (the one lookups use)."""
    return flat.filter(F.col("sector").isNotNull()).groupBy("sector") \
        .agg(F.min("sector_pos").alias("sector_pos"))


def sub_sectors(flat: DataFrame) -> DataFrame:
    """TAX3: sub-sectors of every sector name; the first sector of a name wins."""
    first = first_sector_pos(flat)
    return flat.filter(F.col("sub_pos").isNotNull()) \
        .join(checked_broadcast(first), ["sector", "sector_pos"]) \
        .select("sector", "sub_pos", "sub_sector")


# ---- TAX4 ----

def _err(sector_pos, sub_pos, msg) -> list[Column]:
    return [sector_pos.cast("int").alias("sector_pos"), sub_pos.cast("int").alias("sub_pos"),
            msg.alias("error")]


def validate(flat: DataFrame, expected: int = EXPECTED_SECTORS,
             max_subs: int = MAX_SUB_SECTORS, count_rule: bool = True) -> DataFrame:
    """TAX4: one row per error (empty = valid), in the original wording.

    Rules: sector count; a sector needs a name (else its other rules are
    skipped); banned substrings (one error per word); duplicate sector name
    (each later one); more than ``max_subs`` sub-sectors; sub-sector without a
    name; duplicate sub-sector within a sector. A typed document cannot break
    the shape rules (not a list, not an object); ``validate_json`` has them.
    """
    sectors = flat.select("sector_pos", "sector").dropDuplicates(["sector_pos"])
    has_name = F.col("sector").isNotNull() & (F.col("sector") != "")
    named = sectors.filter(has_name)
    count_err = sectors.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected) \
        .select(*_err(F.lit(None), F.lit(None), F.format_string(
            "expected exactly %d sectors, got %d", F.lit(expected), F.col("n"))))
    no_name = sectors.filter(~has_name).select(*_err(
        F.col("sector_pos"), F.lit(None),
        F.format_string("sector[%d] has no name", F.col("sector_pos"))))
    banned = F.array(*[F.lit(w) for w in BANNED_WORDS])
    banned_err = named.select("sector_pos", "sector", F.explode(banned).alias("word")) \
        .filter(F.instr(F.lower("sector"), F.col("word")) > 0) \
        .select(*_err(F.col("sector_pos"), F.lit(None), F.format_string(
            "sector '%s' contains banned word '%s'", F.col("sector"), F.col("word"))))
    w_dup = Window.partitionBy("sector").orderBy("sector_pos")
    dup_err = named.withColumn("_rn", F.row_number().over(w_dup)).filter("_rn > 1") \
        .select(*_err(F.col("sector_pos"), F.lit(None), F.format_string(
            "duplicate sector name '%s'", F.col("sector"))))
    subs = flat.filter(F.col("sub_pos").isNotNull() & has_name)
    many = subs.groupBy("sector_pos", "sector").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > max_subs).select(*_err(
            F.col("sector_pos"), F.lit(None), F.format_string(
                "sector '%s' has %d sub-sectors (max %d)", F.col("sector"), F.col("n"),
                F.lit(max_subs))))
    sub_named = F.col("sub_sector").isNotNull() & (F.col("sub_sector") != "")
    sub_no_name = subs.filter(~sub_named).select(*_err(
        F.col("sector_pos"), F.col("sub_pos"), F.format_string(
            "sector '%s' sub_sector[%d] has no name", F.col("sector"), F.col("sub_pos"))))
    w_sub = Window.partitionBy("sector_pos", "sub_sector").orderBy("sub_pos")
    sub_dup = subs.filter(sub_named).withColumn("_rn", F.row_number().over(w_sub)) \
        .filter("_rn > 1").select(*_err(
            F.col("sector_pos"), F.col("sub_pos"), F.format_string(
                "duplicate sub-sector '%s' in sector '%s'", F.col("sub_sector"),
                F.col("sector"))))
    out = no_name
    for p in ([count_err] if count_rule else []) + [banned_err, dup_err, many, sub_no_name,
                                                    sub_dup]:
        out = out.unionByName(p)
    return out


def validate_document(doc: DataFrame, expected: int = EXPECTED_SECTORS,
                      max_subs: int = MAX_SUB_SECTORS) -> DataFrame:
    """TAX4 on one document row: a missing or non-list ``sectors`` is the only
    error (the reader leaves it NULL); otherwise the count rule and the rules
    of ``validate``."""
    shape = doc.filter(F.col("sectors").isNull()).select(*_err(
        F.lit(None), F.lit(None), F.lit("'sectors' key missing or not a list")))
    ok = doc.filter(F.col("sectors").isNotNull())
    count_err = ok.filter(F.size("sectors") != expected).select(*_err(
        F.lit(None), F.lit(None), F.format_string(
            "expected exactly %d sectors, got %d", F.lit(expected), F.size("sectors"))))
    rules = validate(flatten(ok.select("sectors")), expected, max_subs, count_rule=False)
    return shape.unionByName(count_err).unionByName(rules)


def validate_json(doc: DataFrame, text: str = "taxonomy_json", expected: int = EXPECTED_SECTORS,
                  max_subs: int = MAX_SUB_SECTORS) -> DataFrame:
    """TAX4 on one raw JSON document: shape rules and the rules of ``validate``.

    The text is read as VARIANT, so a wrong kind anywhere is reported instead
    of turning into NULL: ``sectors`` missing or not a list (then the only
    error), a sector or sub-sector that is not an object, a sector name that
    is not a string, ``sub_sectors`` that is not a list (a missing key is an
    empty list). Text that is not JSON has no ``sectors``.
    """
    def get(v, path, kind="variant"):
        return F.try_variant_get(v, path, kind)

    v = F.try_parse_json(F.col(text))
    is_list = (json_kind(get(v, "$.sectors")) == "array").eqNullSafe(True)
    lists = doc.select(F.when(is_list, get(v, "$.sectors", "array<variant>")).alias("_s"))
    shape = lists.filter(F.col("_s").isNull()).select(*_err(
        F.lit(None), F.lit(None), F.lit("'sectors' key missing or not a list")))
    count_err = lists.filter(F.size("_s") != expected).select(*_err(
        F.lit(None), F.lit(None), F.format_string(
            "expected exactly %d sectors, got %d", F.lit(expected), F.size("_s"))))
    e = lists.filter(F.col("_s").isNotNull()).select(F.posexplode("_s").alias("sector_pos", "_e"))
    return shape.unionByName(count_err).unionByName(_element_errors(e, expected, max_subs))


def validate_elements(elements: DataFrame, pos: str = "sector_pos", text: str = "element",
                      expected: int = EXPECTED_SECTORS, max_subs: int = MAX_SUB_SECTORS) -> DataFrame:
    """The rules of ``validate_json`` where the ``sectors`` list comes as a row for each element.

    ``pos`` is the element's place in the list, ``text`` its JSON (no JSON: not
    an object). No task holds the list, so it may be of any length.
    """
    count_err = elements.agg(F.count(F.lit(1)).cast("int").alias("_n")).filter(F.col("_n") != expected).select(*_err(
        F.lit(None), F.lit(None), F.format_string("expected exactly %d sectors, got %d", F.lit(expected), F.col("_n"))))
    e = elements.select(F.col(pos).cast("int").alias("sector_pos"), F.try_parse_json(F.col(text)).alias("_e"))
    return count_err.unionByName(_element_errors(e, expected, max_subs))


def _element_errors(e: DataFrame, expected: int, max_subs: int) -> DataFrame:
    """Shape rules and name rules of elements (sector_pos, _e)."""
    def get(v, path, kind="variant"):
        return F.try_variant_get(v, path, kind)

    e = e.withColumn("_dict", (json_kind(F.col("_e")) == "object").eqNullSafe(True))
    not_dict = e.filter(~F.col("_dict")).select(*_err(F.col("sector_pos"), F.lit(None), F.format_string(
        "sector[%d] is not a dict", F.col("sector_pos"))))
    name, subs = get(F.col("_e"), "$.name"), get(F.col("_e"), "$.sub_sectors")
    d = e.filter("_dict").select(
        "sector_pos",
        F.when(json_kind(name) == "string", get(F.col("_e"), "$.name", "string")).alias("sector"),
        json_kind(subs).alias("_kind"),
        F.when(json_kind(subs) == "array", get(F.col("_e"), "$.sub_sectors", "array<variant>")).alias("_u"))
    no_list = d.filter((F.col("sector") != "") & (F.col("_kind") != "array")).select(*_err(
        F.col("sector_pos"), F.lit(None), F.format_string("sector '%s' sub_sectors is not a list",
                                                          F.col("sector"))))
    sub = F.col("_sub")
    sub_name = get(sub, "$.name")
    # Names of another kind count when Python takes them as true.
    named = (json_kind(sub_name) == "string") | ~F.to_json(sub_name).isin(
        "null", "false", "0", "0.0", "[]", "{}")
    flat = d.select("sector_pos", "sector", F.posexplode_outer("_u").alias("sub_pos", "_sub")).select(
        F.col("sector_pos").cast("int").alias("sector_pos"), "sector",
        F.col("sub_pos").cast("int").alias("sub_pos"),
        F.when(named, get(sub, "$.name", "string")).alias("sub_sector"),
        (F.col("sub_pos").isNotNull() & ~(json_kind(sub) == "object").eqNullSafe(True)).alias("_odd"))
    odd = flat.filter("_odd").select("sector_pos", "sub_pos", F.col("sector").alias("_sector"))
    # An odd entry has no name, so the only error the rules give it is the missing name.
    rules = validate(flat.drop("_odd"), expected, max_subs, count_rule=False) \
        .join(odd, ["sector_pos", "sub_pos"], "left") \
        .select("sector_pos", "sub_pos", F.when(F.col("_sector").isNotNull(), F.format_string(
            "sector '%s' sub_sector[%d] not a dict", F.col("_sector"), F.col("sub_pos")))
            .otherwise(F.col("error")).alias("error"))
    return not_dict.unionByName(no_list).unionByName(rules)


# ---- TAX5-6 ----

def diff(old_flat: DataFrame, new_flat: DataFrame) -> DataFrame:
    """TAX5: sector names lost (renamed or removed) and added."""
    old = old_flat.select("sector").filter(F.col("sector").isNotNull()).distinct()
    new = new_flat.select("sector").filter(F.col("sector").isNotNull()).distinct()
    return old.subtract(new).select(F.lit("lost").alias("change"), "sector") \
        .unionByName(new.subtract(old).select(F.lit("added").alias("change"), "sector"))


def render_blocks(flat: DataFrame) -> DataFrame:
    """TAX6: the prompt text of each sector (``block``), in sector order.

    ``SECTOR: name``, ``  (description)`` when present, ``  - sub — desc`` or
    ``  - sub`` per sub-sector, then a blank line. The full text is the blocks
    joined by a newline in ``sector_pos`` order (see ``render_text``).
    """
    name = F.coalesce(F.col("sector"), F.lit(""))
    sub = F.coalesce(F.col("sub_sector"), F.lit(""))
    sub_desc = _opt(flat, "sub_description")
    sub_line = F.when(F.coalesce(sub_desc, F.lit("")) != "",
                      F.format_string("  - %s — %s", sub, sub_desc)) \
        .otherwise(F.format_string("  - %s", sub))
    g = flat.groupBy("sector_pos").agg(
        F.first(name).alias("_name"),
        F.first(_opt(flat, "sector_description"), ignorenulls=True).alias("_desc"),
        F.array_sort(F.collect_list(F.when(F.col("sub_pos").isNotNull(),
                                           F.struct("sub_pos", sub_line.alias("l"))))).alias("_s"))
    head = F.concat(F.lit("SECTOR: "), F.col("_name"))
    desc = F.when(F.coalesce(F.col("_desc"), F.lit("")) != "",
                  F.array(F.format_string("  (%s)", F.col("_desc")))) \
        .otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(head), desc, F.transform("_s", lambda s: s["l"]), F.array(F.lit("")))
    return g.select("sector_pos", F.array_join(lines, "\n").alias("block"))


def render_text(flat: DataFrame) -> DataFrame:
    """The whole prompt text in one row (a taxonomy is a bounded document)."""
    b = render_blocks(flat)
    return b.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("sector_pos", "block"))), lambda x: x["block"]), "\n").alias("text"))


# ---- TAX7 ----

def _py_str(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def change_log_lines(logs: DataFrame, key: str = "version_id",
                     log: str = "change_log") -> DataFrame:
    """TAX7: one display line per change-log entry; '(none reported)' when empty.

    Entries are read as raw JSON objects so their key order survives for the
    fallback line of unknown types.
    """
    entries = F.from_json(F.col(log), "array<string>")
    e = logs.select(key, F.posexplode_outer(entries).alias("entry_no", "_e"))
    m = F.from_json(F.col("_e"), "map<string,string>")
    d = e.withColumn("_m", m)

    def get(k):
        return F.coalesce(F.col("_m")[k], F.lit("None"))

    reason = F.coalesce(F.col("_m")["reason"], F.lit(""))
    t = F.coalesce(F.col("_m")["type"], F.lit("?"))
    merged = F.from_json(F.col("_m")["merged"], "array<string>")
    merged_txt = F.when(merged.isNull(), F.lit("None")).otherwise(F.concat(
        F.lit("["), F.array_join(F.transform(merged, _py_str), ", "), F.lit("]")))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(
        F.map_entries(F.col("_m")),
        lambda x: F.concat(_py_str(x["key"]), F.lit(": "),
                           F.when(x["value"].isNull(), F.lit("None"))
                           .otherwise(_py_str(x["value"])))), ", "), F.lit("}"))
    line = (F.when(t == "added_sub_sector", F.format_string(
                "  + Added sub-sector '%s' to sector '%s' — %s",
                get("sub_sector"), get("sector"), reason))
            .when(t == "renamed_sub_sector", F.format_string(
                "  ~ Renamed '%s' → '%s' in sector '%s' — %s",
                get("from"), get("to"), get("sector"), reason))
            .when(t == "merged_sub_sectors", F.format_string(
                "  ⋈ Merged %s → '%s' in sector '%s' — %s",
                merged_txt, get("into"), get("sector"), reason))
            .when(t == "new_sector", F.format_string(
                "  ★ New sector '%s' (replaces '%s') — %s",
                get("name"), get("replaces"), reason))
            .otherwise(F.format_string("  - %s: %s", t, whole)))
    return d.select(key, F.coalesce(F.col("entry_no"), F.lit(0)).alias("entry_no"),
                    F.when(F.col("_e").isNull(), F.lit("(none reported)"))
                    .otherwise(line).alias("line"))


# ---- TAX8-9 ----

def description_batches(eligible: DataFrame, batch: int = CLUSTER_BATCH,
                        order: str = "company_number") -> DataFrame:
    """TAX8: descriptions numbered in key order, cut into batches of ``batch``,
    each with its text block ``[name]: description`` (one per line).

    Numbering uses a distributed dense index; each block holds at most
    ``batch`` rows, never the whole table.
    """
    idx = dense_index(eligible, [order], "_idx")
    # A present-but-NULL name prints as 'None' (Python formatting of None).
    line = F.format_string("[%s]: %s", F.coalesce(F.col("company_name"), F.lit("None")),
                           F.coalesce(F.col("services_description"), F.lit("")))
    b = idx.withColumn("batch_no", F.floor((F.col("_idx") - 1) / batch).cast("bigint"))
    return b.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_idx", line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("block"))


def refresh_context(sample: DataFrame, order: str = "_order") -> DataFrame:
    """TAX9: ``[name] (sector / sub): description`` for the (bounded) context sample."""
    line = F.format_string(
        "[%s] (%s / %s): %s", F.coalesce(F.col("company_name"), F.lit("None")),
        F.coalesce(F.col("sector"), F.lit("None")),
        F.coalesce(_opt(sample, "sub_sector"), F.lit("None")),
        F.coalesce(F.col("services_description"), F.lit("")))
    return sample.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("block"))


# ---- terms shared by TAX10-12 and the lexical classifier ----

def term_array(c) -> Column:
    """Distinct [a-z0-9]+ terms of length >= 3, stop words out."""
    c = F.col(c) if isinstance(c, str) else c
    stop = F.array(*[F.lit(w) for w in TOKEN_STOP_WORDS])
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3)
                                     & ~F.array_contains(stop, t)))


def _not_banned(term: Column) -> Column:
    cond = F.lit(True)
    for w in BANNED_WORDS:
        cond = cond & (F.instr(term, w) == 0)
    return cond


def _usable(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != INSUFFICIENT_DATA)


# ---- TAX10-11: discovery (re-aimed from model clustering) ----

def _ranked_terms(assigned: DataFrame, key: str) -> DataFrame:
    """c-TF-IDF term ranks per cluster: docs in cluster holding the term x idf."""
    docs = assigned.select(key, "cluster", F.explode("terms").alias("term")) \
        .filter(_not_banned(F.col("term")))
    n_docs = assigned.agg(F.count(F.lit(1)).alias("_N"))
    df_all = docs.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    per = docs.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("_dfc"))
    s = attach_one_row(per.join(df_all, "term"), n_docs) \
        .withColumn("weight", F.col("_dfc") * F.log((F.col("_N") + 1) / (F.col("_df") + 1)))
    w = Window.partitionBy("cluster").orderBy(F.col("weight").desc(), F.col("term"))
    return s.withColumn("rank", F.row_number().over(w)) \
        .filter(F.col("rank") <= MAX_SUB_SECTORS + 2).select("cluster", "term", "rank", "weight")


#: Hashed term space of discovery, its fixed number of partitions, and the sub-sectors a new sector begins with
#: (refinement fills the rest).
TERM_SPACE, FIT_PARTITIONS, FIRST_SUBS = 1 << 16, 16, 12


def described_terms(descriptions: DataFrame, key: str = "company_number",
                    text: str = "services_description") -> DataFrame:
    """(key, terms) of the rows with a usable description and a term."""
    return descriptions.filter(_usable(text)).select(key, term_array(text).alias("terms")) \
        .filter(F.size("terms") > 0)


def discover(descriptions: DataFrame, k: int = EXPECTED_SECTORS, seed: int = 42,
             key: str = "company_number", text: str = "services_description",
             space: int = TERM_SPACE, subs: int = FIRST_SUBS):
    """TAX10: a two-level taxonomy from descriptions (TF-IDF + k-means).

    Returns ``(flat, model)``. Terms are hashed into a space of fixed size, so the model and its k centres have a
    fixed size whatever the vocabulary; every term counts, and names come from the terms themselves. Before the fit
    the rows are dealt by a hash of the key over a fixed number of partitions and sorted in them, so seeds and
    sums see the same rows in the same places on any cluster. Sector names are the two best terms of a
    cluster (banned words filtered, made unique); sub-sectors are the next ``subs`` terms (20 at most).
    Too few descriptions for k clusters show up as a validation error (TAX4), not as a smaller k.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    # The fits and the naming all read these term lists: write them once (a sample's descriptions).
    d = described_terms(descriptions, key, text).withColumn("terms", F.array_sort("terms")) \
        .repartition(FIT_PARTITIONS, F.xxhash64(key)).sortWithinPartitions(key, "terms").checkpoint(eager=True)
    if d.isEmpty():
        raise ValueError("no usable descriptions to cluster")
    pipe = Pipeline(stages=[
        HashingTF(inputCol="terms", outputCol="_tf", numFeatures=space, binary=True),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_features", p=2.0),
        KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", maxIter=30),
    ])
    model = pipe.fit(d)
    # Naming reads the assignments several times: write them once to the
    # shared checkpoint folder instead of re-running the description pipeline.
    assigned = model.transform(d).select(key, "cluster", "terms").checkpoint(eager=True)
    return name_clusters(assigned, key, subs), model


def name_clusters(assigned: DataFrame, key: str = "company_number", subs: int = MAX_SUB_SECTORS) -> DataFrame:
    """Flat taxonomy from (key, cluster, terms): names from the top terms."""
    ranked = _ranked_terms(assigned, key).filter(F.col("rank") <= min(subs, MAX_SUB_SECTORS) + 2)
    title = F.initcap(F.col("term"))
    heads = ranked.filter(F.col("rank") <= 2).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", title.alias("t")))),
                                 lambda x: x["t"]), " & ").alias("_name"))
    order = Window.orderBy("cluster")
    dup = Window.partitionBy("_name").orderBy("cluster")
    sectors = heads.withColumn("sector_pos", (F.row_number().over(order) - 1).cast("int")) \
        .withColumn("_k", F.row_number().over(dup)) \
        .withColumn("sector", F.when(F.col("_k") == 1, F.col("_name"))
                    .otherwise(F.format_string("%s %d", F.col("_name"), F.col("_k"))))
    subs = ranked.filter(F.col("rank") > 2).select(
        "cluster", (F.col("rank") - 3).cast("int").alias("sub_pos"), title.alias("sub_sector"))
    flat = sectors.join(subs, "cluster", "left").select(
        "cluster", "sector_pos", "sector",
        F.format_string("Companies whose services centre on %s",
                        F.lower(F.col("_name"))).alias("sector_description"),
        "sub_pos", "sub_sector", F.lit(None).cast("string").alias("sub_description"))
    return flat


def refine(flat: DataFrame, model, descriptions: DataFrame, key: str = "company_number",
           text: str = "services_description", min_support: int = 2, batch: int = CLUSTER_BATCH) -> DataFrame:
    """TAX11: fold further descriptions into the taxonomy, batch after batch in key order.

    Rows are assigned to their nearest sector by the fitted model; see ``refine_batches``. The result keeps
    ``cluster``, so it can be refined again.
    """
    d = dense_index(described_terms(descriptions, key, text), [key], "_idx") \
        .withColumn("batch_no", F.floor((F.col("_idx") - 1) / batch).cast("bigint"))
    return refine_batches(flat, model.transform(d).select("cluster", "batch_no", "terms"), min_support)


def refine_batches(flat: DataFrame, assigned: DataFrame, min_support: int = 2) -> DataFrame:
    """TAX11 on assigned batches (cluster, batch_no, terms).

    A term of a sector's rows that is neither one of its sub-sectors nor in its name becomes one with the batch in
    which the rows that mention it, counted from the first batch on, reach ``min_support``; terms of one batch
    come by that count, then by name, until the sector has 20. So each batch builds on what those before it left,
    and one that brings nothing changes nothing; as the batches only ever add, the fold over them is a running
    count per term and one ranking per sector. Sector names and positions never change.
    """
    sectors = flat.select("cluster", "sector_pos", "sector").distinct()
    per = assigned.select("cluster", "batch_no", F.explode("terms").alias("term")).filter(_not_banned(F.col("term"))) \
        .groupBy("cluster", "term", "batch_no").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy("cluster", "term").orderBy("batch_no")
    reached = per.withColumn("support", F.sum("_n").over(so_far)).filter(F.col("support") >= min_support) \
        .groupBy("cluster", "term").agg(F.min("batch_no").alias("batch_no"), F.min("support").alias("support"))
    existing = flat.filter(F.col("sub_pos").isNotNull()).select("cluster", F.lower("sub_sector").alias("term"))
    fresh = reached.join(existing, ["cluster", "term"], "left_anti").join(sectors, "cluster") \
        .filter(F.instr(F.lower("sector"), F.col("term")) == 0)
    out = add_sub_sectors(flat, fresh.select("sector_pos", "term", "support", "batch_no"))
    return out.join(sectors.select("cluster", "sector_pos"), "sector_pos").select("cluster", *out.columns)


def add_sub_sectors(flat: DataFrame, proposals: DataFrame,
                    max_subs: int = MAX_SUB_SECTORS) -> DataFrame:
    """Append proposed (sector_pos, term, support) as sub-sectors, best first, capped; those with a ``batch_no``
    by batch first.

    Returns the new flat taxonomy with an ``added`` flag on new rows.
    """
    counts = flat.filter(F.col("sub_pos").isNotNull()).groupBy("sector_pos") \
        .agg(F.count(F.lit(1)).alias("_have"), F.max("sub_pos").alias("_last"))
    turn = [F.col("batch_no")] if "batch_no" in proposals.columns else []
    w = Window.partitionBy("sector_pos").orderBy(*turn, F.col("support").desc(), F.col("term"))
    sec = flat.select("sector_pos", "sector", _opt(flat, "sector_description")
                      .alias("sector_description")).dropDuplicates(["sector_pos"])
    # The literal cut trims a sector's terms in every task before its room is known.
    new = proposals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_subs) \
        .join(F.broadcast(counts), "sector_pos", "left") \
        .filter(F.col("_r") <= F.lit(max_subs) - F.coalesce(F.col("_have"), F.lit(0))) \
        .join(F.broadcast(sec), "sector_pos") \
        .select("sector_pos", "sector", "sector_description",
                (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_r")).cast("int").alias("sub_pos"),
                F.initcap("term").alias("sub_sector"),
                F.lit(None).cast("string").alias("sub_description"),
                F.lit(True).alias("added"))
    base = flat.select("sector_pos", "sector", _opt(flat, "sector_description")
                       .alias("sector_description"), "sub_pos", "sub_sector",
                       _opt(flat, "sub_description").alias("sub_description"),
                       F.lit(False).alias("added"))
    # A sector with no sub-sectors has one placeholder row (sub_pos NULL); drop
    # it once the sector gains a real sub-sector.
    gained = new.select("sector_pos").distinct().withColumn("_g", F.lit(True))
    base = base.join(F.broadcast(gained), "sector_pos", "left") \
        .filter(F.col("sub_pos").isNotNull() | F.col("_g").isNull()).drop("_g")
    return base.unionByName(new)


# ---- TAX12: refresh by gap (re-aimed) ----

def gap_terms(state: DataFrame, taxonomy_flat: DataFrame, min_support: int = 3,
              key: str = "company_number", text: str = "services_description") -> DataFrame:
    """TAX12 step 1: frequent terms of UNCLASSIFIED rows and the sector each belongs to.

    Every gap row is first matched to its best sector (most shared terms
    with the sector's placed rows' vocabulary; ties by sector_pos). A term's
    sector is the one most of its gap rows matched. No pairs are built: each
    row contributes its own terms once.
    """
    pos = first_sector_pos(taxonomy_flat)
    placed = state.filter(F.col("sector").isNotNull() & (F.col("sector") != UNCLASSIFIED)
                          & _usable(text)) \
        .join(F.broadcast(pos), "sector") \
        .select("sector_pos", F.explode(term_array(text)).alias("term"))
    vocab = placed.groupBy("sector_pos", "term").agg(F.count(F.lit(1)).alias("_pc"))
    # Support, overlap and votes all read the gap terms: write them once to
    # the shared checkpoint folder (UNCLASSIFIED rows only) rather than
    # re-deriving the state for each. Exchange reuse is not reliable here:
    # each consumer's plan differs below the shared part.
    gap = state.filter((F.col("sector") == UNCLASSIFIED) & _usable(text)) \
        .select(key, F.explode(term_array(text)).alias("term")).checkpoint(eager=True)
    support = gap.groupBy("term").agg(F.count(F.lit(1)).alias("support")) \
        .filter(F.col("support") >= min_support).filter(_not_banned(F.col("term")))
    overlap = gap.join(checked_broadcast(vocab), "term").groupBy(key, "sector_pos") \
        .agg(F.count(F.lit(1)).alias("_shared"))
    wb = Window.partitionBy(key).orderBy(F.col("_shared").desc(), F.col("sector_pos"))
    best = overlap.withColumn("_r", F.row_number().over(wb)).filter("_r = 1") \
        .select(key, "sector_pos")
    votes = gap.join(checked_broadcast(support.select("term")), "term").join(best, key) \
        .groupBy("term", "sector_pos").agg(F.count(F.lit(1)).alias("score"))
    wt = Window.partitionBy("term").orderBy(F.col("score").desc(), F.col("sector_pos"))
    chosen = votes.withColumn("_r", F.row_number().over(wt)).filter("_r = 1").drop("_r")
    names = taxonomy_flat.select("sector_pos", "sector").dropDuplicates(["sector_pos"])
    out = chosen.join(support, "term").join(F.broadcast(names), "sector_pos")
    wr = Window.partitionBy("sector_pos").orderBy(F.col("support").desc(), F.col("term"))
    return out.withColumn("rank", F.row_number().over(wr)) \
        .select("term", "support", "sector_pos", "sector", "score", "rank")


def refresh_by_gap(state: DataFrame, taxonomy_flat: DataFrame, min_support: int = 3):
    """TAX12: add gap terms as sub-sectors (never renaming a sector).

    Returns ``(new_flat, change_log)`` where change_log rows are
    ``added_sub_sector`` entries (sector, sub_sector, reason).
    """
    g = gap_terms(state, taxonomy_flat, min_support)
    existing = taxonomy_flat.filter(F.col("sub_pos").isNotNull()).select(
        "sector_pos", F.lower("sub_sector").alias("term"))
    fresh = g.join(checked_broadcast(existing), ["sector_pos", "term"], "left_anti") \
        .filter(F.instr(F.lower("sector"), F.col("term")) == 0)
    new_flat = add_sub_sectors(taxonomy_flat, fresh.select("sector_pos", "term", "support"))
    added = new_flat.filter("added").join(
        fresh.select("sector_pos", F.initcap("term").alias("sub_sector"), "support"),
        ["sector_pos", "sub_sector"])
    log = added.select(
        "sector_pos", "sub_pos", F.lit("added_sub_sector").alias("type"), "sector",
        "sub_sector", F.format_string("%d unclassified companies mention it",
                                      F.col("support")).alias("reason"))
    return new_flat, log


def change_log_json(log: DataFrame) -> DataFrame:
    """Change-log rows to the JSON text a version stores (one row)."""
    entry = F.to_json(F.struct("type", "sector", "sub_sector", "reason"))
    return log.agg(F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("sector_pos", "sub_pos", entry.alias("e")))),
        lambda x: x["e"]), ","), F.lit("")), F.lit("]")).alias("change_log"))
