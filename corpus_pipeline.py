"""Corpus pipeline: language filter, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``docs``. ``run`` writes each stage's rows as Parquet to the shared folder and rereads them.

Edge cases: rows with null or letterless text leave in the language stage; an empty table passes through as
empty; extra columns are carried along unless their names begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmap.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from marketmap.llm.common import stored, table
from marketmap.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough confidence."""
    return language_id.accepted(docs, language_id.train(docs))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return _with_ids(docs, exact_dedup.exact_groups(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word shingles, similarity 0.8), the smallest doc_id."""
    return _with_ids(docs, near_dedup.near_duplicates(docs))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed windows of the documents."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def _with_ids(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is judged ``kept`` at least once. The ids that go are the smaller side."""
    gone = judged.groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__kept")).filter("not __kept")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_copies),
    ("packing", pack_windows),
]

# The language model, near duplicates and tokenizer have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
