"""Exact deduplication as a stateful stream over content digests.

Three steps:

1. Every document becomes a small landing row: SHA-256 of its normalised text, its identifier and a
   content locator (the file it was read from).
2. A Structured Streaming aggregation keeps one state row per digest, without expiry, in the
   disk-backed (RocksDB) state store: smallest identifier, that row's locator, number of rows. The
   aggregation combines before its shuffle, so a digest that holds a third of all rows sends one row
   per task. Later arrivals update the same state, however late they are.
3. A digest hit is not yet a copy: the full bytes of all documents that share a digest are compared
   (grouped by digest and text; equal texts collapse in the map tasks). Should different texts share a
   digest, each text becomes a group of its own.

Texts are equal when identical after replacing each run of ASCII white space (09-0D, 20) by one space.
Edge cases: null text counts as empty; empty texts form one group; repeated rows with one doc_id count
one by one in group_size, and all of them are kept when they share the smallest id; a null doc_id sorts
after every other and never keeps a group that has an id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmap.llm.common import join_to_heavy_keys, scratch, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # Each batch saves what changed, and the many small stores do not reserve disk in advance.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _keeper():
    """Order of preference for the row that stays: ids first, smallest first."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))


def digest_state(spark: SparkSession, landing: str, state: str, checkpoint: str,
                 files_per_trigger: int | None = None) -> None:
    """Feed new files of ``landing`` (doc_id, digest, locator) to the keyed state; the digests that
    changed are written to ``state/batch=<id>`` (a replayed batch rewrites only itself)."""
    reader = spark.readStream.schema("doc_id long, digest string, locator string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    keyed = reader.parquet(landing).groupBy("digest").agg(
        _keeper().alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("locator"),
                       "group_size").write.mode("overwrite").parquet(f"{state}/batch={batch:09d}")

    with _rocksdb(spark):
        query = keyed.writeStream.outputMode("update").foreachBatch(write) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()


def current_state(spark: SparkSession, state: str) -> DataFrame:
    """One row per digest: what its last batch wrote."""
    schema = "digest string, keep_id long, locator string, group_size long, batch string"
    rows = spark.read.schema(schema).parquet(state)
    last = F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("s")
    return rows.groupBy("digest").agg(last).select("digest", "s.keep_id", "s.locator", "s.group_size")


def landing_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.sha2(normalised(F.col("text")), 256).alias("digest"), F.input_file_name().alias("locator"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text")) \
        .withColumn("digest", F.sha2("text", 256))


def colliding_digests(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests that stand for more than one text, by comparing full bytes; normally none.

    ``hits``: (doc_id, digest) of the rows whose digest occurs more than once. The join is on the
    unique pair of both, so a digest with very many rows is not one join key; grouping by the text
    itself combines equal texts before the shuffle."""
    h = hits.distinct().select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"))
    of_hits = texts.join(h, (F.col("digest") == F.col("h_digest")) & F.col("doc_id").eqNullSafe(F.col("h_id")),
                         "left_semi")
    return of_hits.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").select("digest")


def exact_groups(docs: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that
    stays; null for a text that shares its digest with another)."""
    spark = docs.sparkSession
    root = scratch(spark, "exact")
    landing, state = f"{root}/landing", f"{root}/state"
    landing_rows(docs).write.parquet(landing)
    digest_state(spark, landing, state, f"{root}/stream", files_per_trigger)
    rows = spark.read.schema("doc_id long, digest string, locator string").parquet(landing).select("doc_id", "digest")
    keys = stored(current_state(spark, state), "exact-keys")
    # A digest with one row is found in its own state row; only the others need the join below.
    hits = join_to_heavy_keys(rows, keys.filter("group_size > 1").select("digest", "group_size"), "digest", "group_size",
                              "left_semi")
    texts = _texts(docs)
    split = stored(colliding_digests(texts, hits), "exact-split")
    found = join_to_heavy_keys(rows, keys.join(split, "digest", "left_anti"), "digest", "group_size") \
        .select("doc_id", "keep_id", "group_size", "digest", "locator")
    apart = texts.join(split, "digest", "left_semi")
    kept = apart.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_text = apart.join(kept, ["digest", "text"]) \
        .select("doc_id", "keep_id", "group_size", "digest", F.lit(None).cast("string").alias("locator"))
    return found.unionByName(by_text).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "locator")


ORACLE_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n"""
