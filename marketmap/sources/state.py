"""Research state as an append-only patch log (SRC6-8, RTY2, RFR5).

Plain Spark tables cannot MERGE, so every write appends patches
``(company_number, seq, kind, <row>)`` and the current table is
"last full patch wins, sampled flag is the maximum over all patches".
A full patch replaces the whole row (absent columns become NULL), exactly
like the original upsert; a ``flag`` patch only raises the sampled flag.

``latest`` is one hash aggregate keyed by company_number whose aggregates
(max_by, max) combine map-side, so hot keys shrink before the shuffle.
Compact by writing ``latest`` as a new snapshot and starting a new log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmap.constants import RECLASSIFY_CLEARED, STATE_COLUMNS, UNCLASSIFIED

STATE_TYPES = {
    "company_number": T.StringType(), "company_name": T.StringType(),
    "postcode": T.StringType(), "domain": T.StringType(),
    "domain_confidence": T.StringType(), "domain_method": T.StringType(),
    "website_raw_text_length": T.IntegerType(), "services_description": T.StringType(),
    "specialisms": T.ArrayType(T.StringType()), "sector": T.StringType(),
    "sub_sector": T.StringType(), "classification_confidence": T.StringType(),
    "rationale": T.StringType(), "keywords": T.ArrayType(T.StringType()),
    "sampled_for_discovery": T.IntegerType(), "taxonomy_version_id": T.IntegerType(),
    "processed_at": T.TimestampNTZType(), "error_log": T.StringType(),
}

FULL, FLAG = "full", "flag"


def as_state_row(df: DataFrame) -> DataFrame:
    """Project to the 18 state columns; absent ones become typed NULLs."""
    return df.select(*[
        (F.col(c).cast(STATE_TYPES[c]) if c in df.columns
         else F.lit(None).cast(STATE_TYPES[c])).alias(c)
        for c in STATE_COLUMNS])


def make_patches(rows: DataFrame, seq, kind: str = FULL, stamp: bool = False) -> DataFrame:
    """Rows to patches. ``seq`` is an int or Column that orders patches per key.

    ``stamp`` sets processed_at to the current time, as the upsert does.
    """
    r = as_state_row(rows)
    if stamp:
        r = r.withColumn("processed_at", F.localtimestamp())
    seq_col = seq if isinstance(seq, F.Column) else F.lit(seq)
    return r.select(F.col("company_number"), seq_col.cast("bigint").alias("seq"),
                    F.lit(kind).alias("kind"), *[c for c in STATE_COLUMNS
                                                 if c != "company_number"])


def flag_patches(keys: DataFrame, seq) -> DataFrame:
    """SRC7 as patches: raise the sampled flag for ``keys`` and nothing else."""
    return make_patches(keys.select("company_number")
                        .withColumn("sampled_for_discovery", F.lit(1)), seq, FLAG)


def latest(patches: DataFrame) -> DataFrame:
    """SRC6: current state = last full patch per key; flag = max over all patches."""
    others = [c for c in STATE_COLUMNS if c not in ("company_number",)]
    is_full = F.col("kind") == FULL
    agg = patches.groupBy("company_number").agg(
        F.max_by(F.when(is_full, F.struct(*[F.col(c) for c in others])),
                 F.when(is_full, F.col("seq"))).alias("_r"),
        F.max("sampled_for_discovery").alias("_flag"))
    cols = []
    for c in STATE_COLUMNS:
        if c == "company_number":
            cols.append(F.col(c))
        elif c == "sampled_for_discovery":
            cols.append(F.coalesce(F.col("_flag"), F.lit(0)).cast("int").alias(c))
        else:
            cols.append(F.col(f"_r.{c}").alias(c))
    return agg.select(*cols)


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """SRC6 on a snapshot: replace whole rows by key, keep the sampled maximum."""
    return latest(make_patches(state, 0).unionByName(make_patches(rows, 1)))


def mark_sampled(state: DataFrame, keys: DataFrame) -> DataFrame:
    """SRC7: set sampled_for_discovery = 1 for ``keys``; unknown keys get a bare row."""
    hit = keys.select("company_number").distinct().withColumn("_hit", F.lit(True))
    j = as_state_row(state).join(hit, "company_number", "full_outer")
    return j.select(*[
        F.when(F.col("_hit"), F.lit(1)).otherwise(F.col(c)).cast("int").alias(c)
        if c == "sampled_for_discovery" else F.col(c)
        for c in STATE_COLUMNS])


def resume_join(companies: DataFrame, state: DataFrame) -> DataFrame:
    """SRC8: each input company with its existing state row (columns ``existing_*``)."""
    ex = as_state_row(state)
    ex = ex.select("company_number", *[F.col(c).alias(f"existing_{c}")
                                       for c in STATE_COLUMNS if c != "company_number"])
    return companies.join(ex, "company_number", "left")


def clear_error(state: DataFrame, keys: DataFrame) -> DataFrame:
    """RTY2: error_log = NULL for the given keys; other rows unchanged."""
    hit = keys.select("company_number").distinct().withColumn("_hit", F.lit(True))
    j = as_state_row(state).join(hit, "company_number", "left")
    return j.select(*[
        F.when(F.col("_hit"), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c == "error_log" else F.col(c) for c in STATE_COLUMNS])


def clear_unclassified(state: DataFrame, version) -> DataFrame:
    """RFR5 step 1: blank the six classification columns of UNCLASSIFIED rows at ``version``.

    ``version`` is an int or a Column (e.g. from a one-row join).
    """
    v = version if isinstance(version, F.Column) else F.lit(version)
    hit = (F.col("sector") == UNCLASSIFIED) & (F.col("taxonomy_version_id") == v)
    s = as_state_row(state) if set(STATE_COLUMNS) - set(state.columns) else state
    return s.select(*[
        F.when(hit, F.lit(None).cast(STATE_TYPES[c])).otherwise(F.col(c)).alias(c)
        if c in RECLASSIFY_CLEARED else F.col(c)
        for c in s.columns])
