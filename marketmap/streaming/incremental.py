"""Streaming jobs (STR1-3): incremental classify, drift monitor, spend.

Every sink is ``foreachBatch`` writing ``<table>/batch_id=<id>`` with
overwrite, so a micro-batch replayed after a failure rewrites its own
partition and nothing else. Readers take the latest row per key across
batches. Checkpoints and tables live under the shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketmap.constants import (
    REFRESH_UNCLASSIFIED_THRESHOLD,
    REFRESH_WINDOW,
    UNCLASSIFIED,
)
from marketmap.operators.classify import classify_lexical, leaf_terms
from marketmap.operators.monitor import price_table
from marketmap.operators.partitioning import checked_broadcast
from marketmap.session import list_dirs, path_exists, state_root
from marketmap.sources.companies import dedupe_first


def new_run_dir(spark: SparkSession, name: str) -> str:
    return state_root(spark, "streams", f"{name}-{uuid.uuid4().hex}")


def write_files(df: DataFrame, path: str, files: int, order: str) -> str:
    """Lay ``df`` down as ``files`` parquet files in ``order`` (a stream's input)."""
    df.repartitionByRange(files, order).write.mode("overwrite").parquet(path)
    return path


def _batch_path(table: str, batch_id: int) -> str:
    return os.path.join(table, f"batch_id={batch_id}")


def run_available(stream_writer) -> None:
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


# ---- STR1: incremental classify ----

RESULT_COLS = ["company_number", "sector", "sub_sector", "confidence", "rationale", "keywords",
               "score", "shared"]


def latest_results(spark: SparkSession, table: str) -> DataFrame:
    """Current classification per company: the row of the newest batch."""
    r = spark.read.parquet(table)
    others = [c for c in RESULT_COLS if c != "company_number"]
    g = r.groupBy("company_number").agg(
        F.max_by(F.struct(*others), F.col("batch_id")).alias("_r"))
    return g.select("company_number", *[F.col(f"_r.{c}").alias(c) for c in others])


def incremental_classify(spark: SparkSession, input_dir: str, schema, taxonomy_flat: DataFrame,
                         out_table: str, checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
    """STR1: new input files -> first-wins dedupe -> pending anti-join against the
    results so far -> classify -> one overwrite partition per micro-batch.

    The taxonomy's weighted term table is computed once and checkpointed to
    the shared folder, so micro-batches do not re-derive it.
    """
    terms = leaf_terms(taxonomy_flat).checkpoint(eager=True)

    def process(batch: DataFrame, batch_id: int) -> None:
        # The micro-batch is read by the size check, the anti-join and the
        # scorer: keep it for the duration of this batch only.
        rows = dedupe_first(batch).persist()
        if path_exists(spark, out_table):
            # Keys of this (bounded) micro-batch already placed by earlier batches only: a
            # replayed batch must not take its own first attempt for earlier work. The
            # results table is scanned against the broadcast batch keys, no shuffle.
            keys = checked_broadcast(rows.select("company_number"))
            done = spark.read.parquet(out_table).filter(F.col("batch_id") < batch_id).select("company_number") \
                .join(keys, "company_number", "left_semi").distinct()
            rows = rows.join(done, "company_number", "left_anti")
        out = classify_lexical(rows, taxonomy_flat, terms=terms).select(*RESULT_COLS)
        out.write.mode("overwrite").parquet(_batch_path(out_table, batch_id))
        rows.unpersist()

    stream = spark.readStream.schema(schema) \
        .option("maxFilesPerTrigger", files_per_trigger).parquet(input_dir)
    run_available(stream.writeStream.foreachBatch(process)
                  .option("checkpointLocation", checkpoint))
    return latest_results(spark, out_table)


# ---- STR2: drift monitor ----

def drift_monitor(spark: SparkSession, input_dir: str, schema, out_table: str, checkpoint: str,
                  window: str = "1 day", watermark: str = "1 day",
                  min_total: int = REFRESH_WINDOW,
                  threshold: float = REFRESH_UNCLASSIFIED_THRESHOLD,
                  files_per_trigger: int = 1) -> DataFrame:
    """STR2: unclassified rate per event-time window, with the refresh flag.

    Update mode: each micro-batch emits the windows it changed; the table keeps
    the newest value per window, and the watermark lets old windows' state go.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(input_dir).withColumn("ts", F.col("ts").cast("timestamp")) \
        .withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(F.col("outcome") == UNCLASSIFIED).alias("unclassified"),
        F.count(F.lit(1)).alias("total"))

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     "unclassified", "total") \
            .write.mode("overwrite").parquet(_batch_path(out_table, batch_id))

    run_available(agg.writeStream.outputMode("update").foreachBatch(process)
                  .option("checkpointLocation", checkpoint))
    r = spark.read.parquet(out_table)
    last = r.groupBy("window_start").agg(
        F.max_by(F.struct("unclassified", "total"), F.col("batch_id")).alias("_r"))
    rate = F.col("_r.unclassified") / F.col("_r.total")
    return last.select("window_start", F.col("_r.unclassified").alias("unclassified"),
                       F.col("_r.total").alias("total"), rate.alias("rate"),
                       ((F.col("_r.total") >= min_total) & (rate > threshold)).alias("trigger"))


# ---- STR2 (count-based): the last W completed rows ----

SALTS = 16
LAST_W_SCHEMA = "key string, salt int, company_number string, processed_at timestamp_ntz, unclassified boolean"

def _previous_batch(spark: SparkSession, table: str, batch_id: int) -> int | None:
    ids = [int(d.split("=", 1)[1]) for d in list_dirs(spark, table) if d.startswith("batch_id=")]
    ids = [i for i in ids if i < batch_id]
    return max(ids) if ids else None


def drift_last_w(spark: SparkSession, input_dir: str, schema, out_table: str, checkpoint: str,
                 window: int = REFRESH_WINDOW,
                 threshold: float = REFRESH_UNCLASSIFIED_THRESHOLD,
                 key: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """STR2: unclassified rate over the last ``window`` completed rows (by
    processed_at, then company_number), per ``key`` or overall.

    Each micro-batch unions its completed rows with the previous snapshot,
    keeps the newest row of each company (a reclassified company counts
    once, as in the state) and then the newest ``window`` per key and salt, where the
    salt is one of ``SALTS`` hash groups of companies: a snapshot holds at most ``window`` x ``SALTS``
    rows of a key, no task of a micro-batch merges a whole hot key, and the salts meet when the answer
    is read. ``row_number() <= window`` is planned as a WindowGroupLimit, so every task sends
    at most ``window`` rows of a group to the shuffle. A row of the last ``window`` is among those of its
    salt, so the answer is exact whatever the arrival order, late rows too; each snapshot is its own
    overwrite partition (replay-safe). A stream without any row gives an empty answer.
    """
    k = F.col(key) if key else F.lit("all")

    def newest(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col("processed_at").desc_nulls_last(), F.col("company_number"))
        return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window).drop("_r")

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(F.col("sector").isNotNull()).select(
            k.cast("string").alias("key"), F.pmod(F.xxhash64("company_number"), F.lit(SALTS)).cast("int").alias("salt"),
            "company_number", "processed_at", (F.col("sector") == UNCLASSIFIED).alias("unclassified"))
        prev = _previous_batch(spark, out_table, batch_id)
        if prev is not None:
            rows = rows.unionByName(spark.read.parquet(_batch_path(out_table, prev)))
        once = Window.partitionBy("key", "salt", "company_number") \
            .orderBy(F.col("processed_at").desc_nulls_last(), F.col("unclassified"))
        rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
        newest(rows, "key", "salt").write.mode("overwrite").parquet(_batch_path(out_table, batch_id))

    stream = spark.readStream.schema(schema) \
        .option("maxFilesPerTrigger", files_per_trigger).parquet(input_dir)
    run_available(stream.writeStream.foreachBatch(process)
                  .option("checkpointLocation", checkpoint))
    last = _previous_batch(spark, out_table, 1 << 62)
    snap = spark.createDataFrame([], LAST_W_SCHEMA) if last is None else spark.read.parquet(_batch_path(out_table, last))
    agg = newest(snap, "key").groupBy("key").agg(F.count_if("unclassified").alias("unclassified"),
                                                 F.count(F.lit(1)).alias("total"))
    rate = F.col("unclassified") / F.greatest(F.col("total"), F.lit(1)).cast("double")
    return agg.select("key", "unclassified", "total", rate.alias("rate"),
                      ((F.col("total") >= window) & (rate > threshold)).alias("trigger"))


# ---- STR3: streaming spend ----

def streaming_spend(spark: SparkSession, input_dir: str, schema, out_table: str,
                    checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
    """STR3: calls and GBP by priced service, maintained in update mode."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(input_dir)
    agg = s.groupBy("service").agg(F.count(F.lit(1)).alias("calls"))

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(out_table, batch_id))

    run_available(agg.writeStream.outputMode("update").foreachBatch(process)
                  .option("checkpointLocation", checkpoint))
    r = spark.read.parquet(out_table)
    last = r.groupBy("service").agg(F.max_by("calls", "batch_id").alias("calls"))
    prices = F.broadcast(price_table(spark))
    return last.join(prices, "service").select(
        "service", "calls", (F.col("calls") * F.col("unit_price_e5") / F.lit(100000.0))
        .alias("gbp"))
