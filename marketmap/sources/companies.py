"""Company ingest: read, clean, key and de-duplicate (SRC1-4).

Rows carry an explicit ``input_seq`` (file order) from the moment they are
read, so "first row wins" never depends on partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmap.constants import FALLBACK_HASH_CHARS, FALLBACK_SLUG_CHARS
from marketmap.functions.text import blank_to_null, py_strip, slug

COMPANY_COLUMNS = ["company_number", "company_name", "postcode"]


def require_company_name(df: DataFrame) -> DataFrame:
    """SRC2: fail before reading any row when the header lacks company_name."""
    if "company_name" not in df.columns:
        raise ValueError("input CSV must have a 'company_name' column")
    return df


def read_companies_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: header-driven CSV, all columns as text, quoted newlines allowed.

    ``input_seq`` orders rows by (file, position in file). A multi-line CSV
    is not splittable, so each file is one task: feed many files (or convert
    once to Parquet) for parallel reads.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').option("encoding", "UTF-8")
           .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    require_company_name(raw)
    cols = [F.col(f"`{c}`").cast("string").alias(c) if c in raw.columns
            else F.lit(None).cast("string").alias(c) for c in COMPANY_COLUMNS]
    # Within one file partition, monotonically_increasing_id follows file order.
    return raw.select(
        F.struct(F.input_file_name().alias("file"),
                 F.monotonically_increasing_id().alias("pos")).alias("input_seq"),
        *cols)


def clean_companies(raw: DataFrame) -> DataFrame:
    """SRC1 field rules: strip each field, drop empty names, empty postcode -> NULL."""
    name = py_strip(F.col("company_name"))
    return (raw.select(
        "input_seq",
        blank_to_null(py_strip(F.col("company_number"))).alias("company_number"),
        F.coalesce(name, F.lit("")).alias("company_name"),
        blank_to_null(py_strip(F.col("postcode"))).alias("postcode"))
        .filter(F.col("company_name") != ""))


def fallback_key(name_col) -> F.Column:
    """SRC3: 'slug:' + first 40 of the slug, or 'hash:' + 16 hex of md5(name)."""
    s = slug(name_col)
    return F.when(s != "", F.concat(F.lit("slug:"), F.substring(s, 1, FALLBACK_SLUG_CHARS))) \
        .otherwise(F.concat(F.lit("hash:"),
                            F.substring(F.md5(name_col), 1, FALLBACK_HASH_CHARS)))


def key_companies(clean: DataFrame) -> DataFrame:
    """SRC3: fill a missing company_number with the fallback key."""
    return clean.withColumn(
        "company_number",
        F.coalesce(F.col("company_number"), fallback_key(F.col("company_name"))))


def dedupe_first(keyed: DataFrame, key: str = "company_number",
                 order: str = "input_seq") -> DataFrame:
    """SRC4: keep the first row (lowest ``order``) per key.

    ``min_by`` is a declarative aggregate: each map task reduces its rows to
    one per key before the shuffle, so a key holding a third of the input
    costs one row per task on the wire.
    """
    others = [c for c in keyed.columns if c != key]
    picked = keyed.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def load_companies(raw: DataFrame) -> DataFrame:
    """SRC1-4 from rows already read (``input_seq`` + the three text columns)."""
    return dedupe_first(key_companies(clean_companies(raw)))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    return load_companies(read_companies_csv(spark, path))
