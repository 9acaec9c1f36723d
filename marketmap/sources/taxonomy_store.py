"""Taxonomy documents and their version table (SRC9-12).

A taxonomy is a small nested document (validated to 20 sectors x 20
sub-sectors); the version table is append-only Parquet partitioned by
``version_id`` under the shared state folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmap.session import path_exists

from marketmap.operators.partitioning import attach_one_row

SUB_TYPE = T.StructType([T.StructField("name", T.StringType()),
                         T.StructField("description", T.StringType())])
SECTOR_TYPE = T.StructType([T.StructField("name", T.StringType()),
                            T.StructField("description", T.StringType()),
                            T.StructField("sub_sectors", T.ArrayType(SUB_TYPE))])
TAXONOMY_TYPE = T.StructType([T.StructField("sectors", T.ArrayType(SECTOR_TYPE))])

VERSION_SCHEMA = T.StructType([
    T.StructField("version_id", T.IntegerType()),
    T.StructField("taxonomy_json", T.StringType()),
    T.StructField("company_count_used", T.IntegerType()),
    T.StructField("refresh_trigger", T.StringType()),
    T.StructField("change_log", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("notes", T.StringType()),
])


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: read the JSON document (one row, column ``sectors``)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(
            f"taxonomy.json not found at {path}. Run `discover` mode first.")
    return spark.read.schema(TAXONOMY_TYPE).option("multiLine", True).json(path)


def nest(flat: DataFrame) -> DataFrame:
    """Flat (sector_pos, sector, sub_pos, sub_sector[, descriptions]) to one document row.

    A taxonomy is configuration (bounded by validation), not data, so one
    row holding it is fine.
    """
    def opt(c):
        return F.col(c) if c in flat.columns else F.lit(None).cast("string")

    subs = flat.groupBy("sector_pos").agg(
        F.first("sector").alias("name"),
        F.first(opt("sector_description"), ignorenulls=True).alias("description"),
        F.array_sort(F.collect_list(F.when(F.col("sub_pos").isNotNull(), F.struct(
            F.col("sub_pos").alias("pos"), F.col("sub_sector").alias("name"),
            opt("sub_description").alias("description"))))).alias("_subs"))
    sectors = subs.select(F.struct(
        F.col("sector_pos").alias("pos"), "name", "description",
        F.transform("_subs", lambda s: F.struct(s["name"].alias("name"),
                                                s["description"].alias("description")))
        .alias("sub_sectors")).alias("s"))
    doc = sectors.agg(F.array_sort(F.collect_list("s")).alias("_sectors"))
    return doc.select(F.transform("_sectors", lambda s: F.struct(
        s["name"].alias("name"), s["description"].alias("description"),
        s["sub_sectors"].alias("sub_sectors"))).alias("sectors"))


def to_json_text(doc: DataFrame) -> DataFrame:
    return doc.select(F.to_json(F.struct("sectors")).alias("taxonomy_json"))


def empty_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VERSION_SCHEMA)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return empty_versions(spark)
    return spark.read.schema(VERSION_SCHEMA).parquet(path)


def append_version(spark: SparkSession, path: str, taxonomy_json: DataFrame,
                   company_count: DataFrame | int, trigger: str,
                   change_log: str | None = None, notes: str = "") -> DataFrame:
    """SRC10: store a new version (id = max + 1) and return its one-row frame.

    Single writer by design (as in the original); the partition per
    version keeps each document as its own directory.
    """
    versions = read_versions(spark, path)
    # The new id is a one-row decision.
    vid = versions.agg(F.coalesce(F.max("version_id"), F.lit(0))).first()[0] + 1
    if isinstance(company_count, DataFrame):
        cnt = company_count.select(F.col(company_count.columns[0]).cast("int")
                                   .alias("company_count_used"))
    else:
        cnt = spark.range(1).select(F.lit(company_count).cast("int")
                                    .alias("company_count_used"))
    row = (attach_one_row(taxonomy_json.select("taxonomy_json"), cnt)
           .select(F.lit(vid).cast("int").alias("version_id"), "taxonomy_json",
                   "company_count_used",
                   F.lit(trigger).alias("refresh_trigger"),
                   F.lit(change_log).cast("string").alias("change_log"),
                   F.localtimestamp().alias("created_at"),
                   F.lit(notes).cast("string").alias("notes")))
    row.write.mode("append").partitionBy("version_id").parquet(path)
    return read_versions(spark, path).filter(F.col("version_id") == vid)


def latest_version(versions: DataFrame) -> DataFrame:
    """SRC11: newest version id, NULL when there is none."""
    return versions.agg(F.max("version_id").alias("version_id"))


def history(versions: DataFrame) -> DataFrame:
    """SRC12: versions by id with the display rules of the history view."""
    return versions.select(
        "version_id",
        F.substring(F.col("created_at").cast("string"), 1, 19).alias("created_at"),
        F.coalesce(F.col("refresh_trigger"), F.lit("")).alias("refresh_trigger"),
        F.coalesce(F.col("company_count_used"), F.lit(0)).alias("company_count_used"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
    ).orderBy("version_id")


def taxonomy_from_python(spark: SparkSession, doc: dict) -> DataFrame:
    """A document held as a Python dict (e.g. from a model) as a one-row frame."""
    text = spark.createDataFrame([(json.dumps(doc),)], "j string")
    return text.select(F.from_json("j", TAXONOMY_TYPE).alias("d")).select("d.sectors")
