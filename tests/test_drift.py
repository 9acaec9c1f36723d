"""STR2: both drift monitors with late rows, hot keys and no rows."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from marketmap.operators.monitor import rolling_unclassified
from marketmap.streaming import incremental as S

ROW = "company_number string, sector string, area string, processed_at timestamp_ntz"


def stream_files(spark, df, files, order):
    run = tempfile.mkdtemp(prefix="mm-drift-")
    src = S.write_files(df, os.path.join(run, "in"), files, order)
    return run, src, spark.read.parquet(src).schema


def outcomes(spark):
    """3,000 rows in shuffled order, so that most files hold late rows; one area holds nearly all of them; ties in time,
    rows without a sector or a time."""
    rng = random.Random(3)
    rows = [(f"{i:05d}", rng.choice([None, "UNCLASSIFIED", "Farming", "Energy"]), "RH" if rng.random() < 0.95 else "SW",
             None if i % 97 == 0 else f"2024-01-{1 + i % 28:02d} 0{i % 7}:00:00") for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, company_number string, sector string, area string, t string") \
        .withColumn("processed_at", F.col("t").cast("timestamp_ntz")).drop("t")


def test_last_w_equals_batch_with_late_rows(spark):
    df = outcomes(spark)
    run, src, schema = stream_files(spark, df, 8, "seq")
    out = os.path.join(run, "out")
    for window in (100, 5000):
        path = f"{out}{window}"
        got = S.drift_last_w(spark, src, schema, path, os.path.join(run, f"c{window}"), window=window).collect()
        want = rolling_unclassified(df, window).first()
        assert [(r["unclassified"], r["total"]) for r in got] == [tuple(want)]
    batches = [d for d in os.listdir(f"{out}100") if d.startswith("batch_id=")]
    assert len(batches) == 8
    for b in batches:  # the snapshot is bounded, and no group of a key passes the window
        kept = spark.read.parquet(os.path.join(f"{out}100", b)).groupBy("key", "salt").count().collect()
        assert max(r["count"] for r in kept) <= 100 and len(kept) <= S.SALTS


def test_last_w_by_key(spark):
    df = outcomes(spark)
    run, src, schema = stream_files(spark, df, 5, "seq")
    got = {r["key"]: (r["unclassified"], r["total"]) for r in S.drift_last_w(
        spark, src, schema, os.path.join(run, "out"), os.path.join(run, "ckpt"), window=60, key="area").collect()}
    assert got == {a: tuple(rolling_unclassified(df.filter(F.col("area") == a), 60).first()) for a in ("RH", "SW")}


def test_last_w_replay_replaces_its_snapshot(spark):
    """A batch that ran but was not committed runs again and gives the same answer."""
    df = outcomes(spark)
    run, src, schema = stream_files(spark, df, 4, "seq")
    out, ckpt = os.path.join(run, "out"), os.path.join(run, "ckpt")
    want = S.drift_last_w(spark, src, schema, out, ckpt, window=100).collect()
    os.remove(os.path.join(ckpt, "commits", "3"))
    crc = os.path.join(ckpt, "commits", ".3.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert S.drift_last_w(spark, src, schema, out, ckpt, window=100).collect() == want


def test_last_w_without_rows(spark):
    df = spark.createDataFrame([], ROW)
    run = tempfile.mkdtemp(prefix="mm-drift-")
    src = os.path.join(run, "in")
    df.write.parquet(src)
    got = S.drift_last_w(spark, src, df.schema, os.path.join(run, "out"), os.path.join(run, "ckpt"))
    assert got.columns == ["key", "unclassified", "total", "rate", "trigger"] and got.count() == 0


def test_window_monitor_drops_rows_behind_the_watermark(spark):
    """A row counts as late by the watermark that the batch before ran with, so the too late one is in the third."""
    rows = [(0, "2024-01-10", "placed"), (1, "2024-01-10", "UNCLASSIFIED"),   # first file
            (2, "2024-01-09", "UNCLASSIFIED"),                                # late, in time
            (3, "2024-01-01", "placed"), (4, "2024-01-11", "placed")]         # too late; new
    df = spark.createDataFrame(rows, "seq int, ts string, outcome string").withColumn("ts", F.col("ts").cast("timestamp"))
    run = tempfile.mkdtemp(prefix="mm-drift-")
    src = os.path.join(run, "in")
    for part in ((0, 1), (2,), (3, 4)):
        df.filter(F.col("seq").isin(*part)).coalesce(1).write.mode("append").parquet(src)
    got = S.drift_monitor(spark, src, df.schema, os.path.join(run, "out"), os.path.join(run, "ckpt"),
                          window="1 day", watermark="2 days", min_total=2, threshold=0.4)
    assert sorted((str(r["window_start"])[:10], r["unclassified"], r["total"], r["trigger"]) for r in got.collect()) == [
        ("2024-01-09", 1, 1, False), ("2024-01-10", 1, 2, True), ("2024-01-11", 0, 1, False)]
