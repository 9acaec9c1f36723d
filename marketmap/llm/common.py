"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmap.session import ensure_checkpoint_dir

HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and keeps columns prunable."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (a null id counts as empty text)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_FOLDS == 0


def hash_fraction(key: Column, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) of ``key``."""
    h = F.xxhash64(F.lit(seed), key.cast("string"))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


#: A key that holds this share of the rows or more is joined by broadcast: there are at most 1 / share such keys.
HEAVY_SHARE = 1 / 1000


def join_to_heavy_keys(rows: DataFrame, keys: DataFrame, on: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keys`` (one row for each ``on``, with the number ``size`` of rows that carry it); ``how``:
    inner or left_semi. A join by shuffle would send a heavy key's rows to one task: those keys, at most
    1 / HEAVY_SHARE by their sizes, are broadcast instead, and their rows stay where they are."""
    total = keys.agg(F.sum(size)).first()[0] or 0
    is_heavy = F.col(size) >= max(2, total * HEAVY_SHARE)
    heavy, light = keys.filter(is_heavy), keys.filter(~is_heavy)
    of_heavy = rows.join(F.broadcast(heavy), on, how)
    others = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on, how)
    return of_heavy.unionByName(others)
