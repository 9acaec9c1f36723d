"""A classify run in chunks with the taxonomy refresh inside it (STR1, CLS9, MON2, MON6-8).

Pending rows are numbered once in input order and cut into chunks. Each chunk is placed by the newest taxonomy version,
written to the patch log, and followed by the refresh trigger; a refresh that is accepted changes the version
of the chunks after it. The same step serves a stream of arriving files (``foreachBatch``).

A step may be replayed at any point. Everything it writes lies under numbers that follow from its chunk: four
patch batches (stages, places, cleared rows, rows placed again), its tail of the last W places, its calls, and last
its ledger row, which marks it as done. A version is marked with the run and chunk that made it, so a replayed
refresh finds it instead of making another, and a replayed chunk is placed by the version it was placed by
first. A step reads its own rows, the ledger row and tail of the step before, and nothing that grows with the
run; the whole state is read at the start and by a refresh.

Only an accepted refresh ties a chunk to those before it, so a whole run of the lexical scorer looks ahead: the chunks
of a span are placed in one job by the version at its start, and so are their counts of the last W places. What
lies behind an accepted refresh is thrown away and placed anew, which is why a span is one chunk at first and
after a refresh and then doubles. Patches, calls and ledger rows are those of single steps; the tail is written where
a step after may begin (the end of a span and a chunk with a trigger). A model's answers are paid for, so it is never asked ahead.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketmap.constants import (
    CHECKPOINT_EVERY,
    REFRESH_EVERY,
    REFRESH_UNCLASSIFIED_THRESHOLD,
    REFRESH_WINDOW,
    UNCLASSIFIED,
)
from marketmap.operators.classify import classify_lexical, leaf_terms, pending, validate_proposals
from marketmap.operators.model import Model, ResponseLog, classify_with_model
from marketmap.operators.monitor import refresh_trigger
from marketmap.operators.partitioning import top_k
from marketmap.operators.sequence import dense_index
from marketmap.session import list_dirs, path_exists
from marketmap.sources.companies import dedupe_first
from marketmap.sources.state import make_patches

LEDGER = ("chunk_no int, version_id int, processed long, unclassified long, total long, rows_since_refresh long, "
          "trigger string, new_version_id int, reason string")
CALLS = "ts timestamp_ntz, company_id string, service string, outcome string"
TAIL = ["company_number", "sector", "processed_at"]
#: Patch batches of a step: places, cleared rows, rows placed again (and one to spare).
PATCHES_OF_STEP = 4
#: Chunks that are placed ahead in one job, at most: their counts, a row each, come to the driver.
MOST_AHEAD = 1024


def queue_chunks(rows: DataFrame, path: str, chunk: int = CHECKPOINT_EVERY, order: str = "input_seq") -> int:
    """Write ``rows`` in chunks of ``chunk`` in input order, a folder each; returns how many."""
    numbered = dense_index(rows, [order, "company_number"], "_seq")
    no = F.floor((F.col("_seq") - 1) / chunk).cast("int")
    numbered.withColumn("chunk_no", no).drop("_seq").repartition("chunk_no") \
        .write.mode("overwrite").partitionBy("chunk_no").parquet(path)
    return queued_chunks(rows.sparkSession, path)


def queued_chunks(spark: SparkSession, path: str) -> int:
    """Chunks under ``path``: their folders are numbered from 0."""
    return sum(d.startswith("chunk_no=") for d in list_dirs(spark, path))


class Rollout:
    """The steps of one run over ``store`` (patch log and versions; see plans/modes.py).

    ``refresh(trigger, tag, cleared, placed)`` makes a refresh under a mark and two patch batches and returns
    a dict with ``new_version_id`` (None when refused) and ``reason``. ``model``: see operators/model.py; without one the
    lexical scorer places the rows."""

    def __init__(self, store, run_id: str, patch: Callable[[DataFrame, DataFrame, int], DataFrame],
                 refresh: Callable[[str, str, int, int], dict] | None = None, model: Model | None = None,
                 window: int = REFRESH_WINDOW, threshold: float = REFRESH_UNCLASSIFIED_THRESHOLD,
                 every: int = REFRESH_EVERY):
        self.store, self.spark, self.run_id = store, store.spark, run_id
        self.root = os.path.join(store.root, "runs", run_id)
        self.patch, self.refresh, self.model = patch, refresh, model
        self.window, self.threshold, self.every = window, threshold, every
        self.log = ResponseLog(self.spark, os.path.join(store.root, "responses"))
        self.first = self._start()
        self._version: int | None = None
        self._flat: DataFrame | None = None
        self._terms: DataFrame | None = None

    # -- what a run has written --
    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _start(self) -> int:
        """First patch batch of the run, fixed when it starts (with the last W places before it)."""
        mark = self._path("start")
        if not path_exists(self.spark, os.path.join(mark, "_SUCCESS")):
            self._write_tail(self.store.current(), -1)
            row = self.spark.createDataFrame([(self.store._next_batch(),)], "first int")
            row.write.mode("overwrite").parquet(mark)
        return self.spark.read.parquet(mark).first()["first"]

    def patch_batch(self, chunk_no: int, k: int = 0) -> int:
        return self.first + PATCHES_OF_STEP * chunk_no + k

    def _ledger_folders(self) -> list[tuple[int, str]]:
        """Folders of the ledger by the last chunk in them: a step's, or those of a span's steps."""
        ends = sorted(int(d.split("=", 1)[1]) for d in list_dirs(self.spark, self._path("ledger")) if d.startswith("step="))
        return [(n, self._path("ledger", f"step={n}")) for n in ends]

    def _is_whole(self, path: str) -> bool:
        return path_exists(self.spark, os.path.join(path, "_SUCCESS"))

    def ledger_row(self, chunk_no: int):
        """The row of a step that is done, else None. It lies in the first whole folder that ends at the chunk or after it."""
        path = next((p for n, p in self._ledger_folders() if n >= chunk_no and self._is_whole(p)), None)
        return path and self.spark.read.schema(LEDGER).parquet(path).filter(F.col("chunk_no") == chunk_no).first()

    def ledger(self) -> DataFrame:
        """A row for each finished step."""
        whole = [p for _, p in self._ledger_folders() if self._is_whole(p)]
        return self.spark.read.schema(LEDGER).parquet(*whole) if whole else self.spark.createDataFrame([], LEDGER)

    def _write_ledger(self, rows: list[tuple]) -> None:
        """Mark the steps of ``rows`` (LEDGER, in order) as done."""
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(
            self._path("ledger", f"step={rows[-1][0]}"))

    def _tail(self, chunk_no: int) -> DataFrame:
        return self.spark.read.parquet(self._path("tail", f"step={chunk_no}"))

    def _write_tail(self, rows: DataFrame, chunk_no: int) -> None:
        """The newest ``window`` rows with a sector (MON1's order)."""
        placed = rows.filter(F.col("sector").isNotNull()).select(*TAIL)
        newest = top_k(placed, [F.col("processed_at").desc_nulls_last(), F.col("company_number")], self.window)
        newest.write.mode("overwrite").parquet(self._path("tail", f"step={chunk_no}"))

    # -- one step --
    def _tag(self, chunk_no: int | str) -> str:
        return f"run {self.run_id} chunk {chunk_no}"

    def _taxonomy(self, chunk_no: int) -> tuple[int, DataFrame, DataFrame]:
        """The newest version but one that this very step or a later one made: (version, taxonomy, its weighted terms)."""
        mine = self._tag("")
        of = F.when(F.contains("notes", F.lit(mine)), F.substring_index("notes", mine, -1).try_cast("int"))
        v = self.store.versions_df().filter(F.coalesce(of < chunk_no, F.lit(True))).agg(F.max("version_id")).first()[0]
        if v is None:
            raise RuntimeError("No taxonomy version yet: run discover first.")
        if v != self._version:
            flat = self.store.taxonomy(v).checkpoint(eager=True)
            self._version, self._flat, self._terms = v, flat, leaf_terms(flat).checkpoint(eager=True)
        return self._version, self._flat, self._terms

    def _placed(self, rows: DataFrame, chunk_no: int) -> tuple[int, DataFrame]:
        version, flat, terms = self._taxonomy(chunk_no)
        if self.model:
            return version, classify_with_model(rows, flat, version, self.model, self.log)
        return version, validate_proposals(classify_lexical(rows, flat, terms=terms), flat)

    def step(self, rows: DataFrame, chunk_no: int):
        """Place the state rows of one chunk and check the trigger; returns its ledger row. Done steps are left alone."""
        done = self.ledger_row(chunk_no)
        if done is not None:
            return done
        b = self.patch_batch(chunk_no)
        version, placed = self._placed(rows, chunk_no)
        self.store.append_at(self.patch(placed, rows, version), b)
        written = self.store.batch(b)
        self._write_calls(written, chunk_no)
        self._write_tail(written.select(*TAIL).unionByName(self._tail(chunk_no - 1)), chunk_no)
        since, processed = self._since(chunk_no), written.count()
        rolling = self._tail(chunk_no).agg(F.count_if(F.col("sector") == UNCLASSIFIED).alias("unclassified"),
                                           F.count(F.lit(1)).alias("total"))
        t = refresh_trigger(rolling, since + processed, self.every, self.window, self.threshold).first()
        trigger = t["trigger"] if processed else None
        result = self._refreshed(trigger, chunk_no)
        self._write_ledger([(chunk_no, version, processed, t["unclassified"], t["total"], t["rows_since_refresh"],
                             trigger, result.get("new_version_id"), result.get("reason"))])
        return self.ledger_row(chunk_no)

    def _since(self, chunk_no: int) -> int:
        """Rows of the run since its last refresh, before ``chunk_no``."""
        before = self.ledger_row(chunk_no - 1)
        return 0 if before is None or before["new_version_id"] is not None else before["rows_since_refresh"]

    def _refreshed(self, trigger: str | None, chunk_no: int) -> dict:
        """What the refresh after ``chunk_no`` came to; nothing without a trigger."""
        if not trigger or not self.refresh:
            return {}
        b = self.patch_batch(chunk_no)
        result = self.refresh(trigger, self._tag(chunk_no), b + 1, b + 2)
        if result.get("new_version_id"):
            # Rows placed again are the newest now; a refresh is rare and reads the state anyway.
            self._write_tail(self.store.current(), chunk_no)
        return result

    # -- many steps --
    def _place_ahead(self, rows: DataFrame, first: int, last: int) -> tuple[int, DataFrame]:
        """Patches of the queued chunks ``first`` to ``last`` by the version at ``first``, written once with their chunk_no.

        The chunk rides in the key, so a company is placed once in each chunk it lies in; a later chunk's rows are
        newer by a microsecond."""
        keyed = rows.withColumn("company_number", F.concat(F.col("chunk_no").cast("string"), F.lit(":"), "company_number")) \
            .drop("chunk_no")
        version, placed = self._placed(keyed, first)
        chunk = F.substring_index("company_number", ":", 1).cast("int")
        batch = F.lit(self.first) + PATCHES_OF_STEP * chunk.cast("long")
        later = F.make_dt_interval(secs=(F.col("chunk_no") - first).cast("decimal(18,6)") / 1_000_000)
        path = self._path("ahead")
        make_patches(self.patch(placed, keyed, version), batch).withColumn("chunk_no", chunk) \
            .withColumn("company_number", F.substring("company_number", F.instr("company_number", ":") + 1, F.length("company_number"))) \
            .withColumn("processed_at", F.localtimestamp() + later) \
            .write.mode("overwrite").parquet(path)
        return version, self.spark.read.parquet(path)

    def _count_ahead(self, placed: DataFrame, first: int, last: int) -> list:
        """MON1-2 after each of the chunks: chunk_no, processed, unclassified, total, rows_since_refresh, trigger.

        The last W places are whole chunks and the newest rows of the one before them. Chunks are counted, and
        their rows ranked, each by itself; sums over chunks are taken of their counts."""
        sectors = placed.select("chunk_no", *TAIL).unionByName(self._tail(first - 1).withColumn("chunk_no", F.lit(first - 1)))
        unc = F.when(F.col("sector") == UNCLASSIFIED, 1).otherwise(0)
        counts = {r["chunk_no"]: r for r in sectors.groupBy("chunk_no").agg(
            F.count(F.lit(1)).alias("rows"), F.count("sector").alias("n"), F.sum(unc).alias("u")).collect()}
        chunks = range(first - 1, last + 1)
        n, u = ([0, *accumulate(counts[c][k] if c in counts else 0 for c in chunks)] for k in ("n", "u"))
        cuts, plain = [], []  # windows that begin inside a chunk, and their part in whole chunks
        for i in range(1, len(chunks)):
            start = max(0, n[i + 1] - self.window)
            k = min(bisect_right(n, start), i + 1)  # rows of chunks before k - 1 are out, those from k on are in
            cuts.append((chunks[i], chunks[k - 1], n[k] - start))
            plain.append((chunks[i], counts[chunks[i]]["rows"] if chunks[i] in counts else 0, u[i + 1] - u[k], n[i + 1] - start))
        newest = Window.partitionBy("chunk_no").orderBy(F.col("processed_at").desc_nulls_last(), "company_number")
        ranked = sectors.filter(F.col("sector").isNotNull()).select(
            F.col("chunk_no").alias("of_chunk"), F.row_number().over(newest).alias("rank"),
            F.sum(unc).over(newest.rowsBetween(Window.unboundedPreceding, 0)).alias("u"))
        part = ranked.join(F.broadcast(self.spark.createDataFrame(cuts, "chunk_no int, of_chunk int, rank int")), ["of_chunk", "rank"])
        more = {r["chunk_no"]: r["u"] for r in part.select("chunk_no", "u").collect()}
        since = accumulate((p[1] for p in plain), initial=self._since(first))
        next(since)
        rolling = [(c, rows, whole + more.get(c, 0), total, s) for (c, rows, whole, total), s in zip(plain, since)]
        frame = self.spark.createDataFrame(
            rolling, "chunk_no int, processed long, unclassified long, total long, rows_since_refresh long")
        return refresh_trigger(frame, F.col("rows_since_refresh"), self.every, self.window, self.threshold) \
            .orderBy("chunk_no").collect()

    def _publish(self, placed: DataFrame, first: int, last: int) -> None:
        """The patch batches of the chunks ``first`` to ``last`` from what was placed ahead, and the tail after them."""
        rows = placed.filter(F.col("chunk_no").between(first, last))
        rows.withColumn("batch_id", F.col("seq")).drop("chunk_no").repartition("batch_id") \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.store.patches)
        self._write_tail(rows.select(*TAIL).unionByName(self._tail(first - 1)), last)

    def steps(self, queue: DataFrame, first: int, last: int) -> int:
        """The steps of the queued chunks from ``first`` on, up to ``last`` or an accepted refresh; returns the next chunk."""
        version, placed = self._place_ahead(queue.filter(F.col("chunk_no").between(first, last)), first, last)
        rows = []
        for t in self._count_ahead(placed, first, last):
            chunk_no = t["chunk_no"]
            trigger = t["trigger"] if t["processed"] else None
            rows.append((chunk_no, version, t["processed"], t["unclassified"], t["total"], t["rows_since_refresh"], trigger))
            if chunk_no < last and not (trigger and self.refresh):
                continue
            self._publish(placed, rows[0][0], chunk_no)
            result = self._refreshed(trigger, chunk_no)
            self._write_ledger([(*r, None, None) for r in rows[:-1]] +
                               [(*rows[-1], result.get("new_version_id"), result.get("reason"))])
            rows = []
            if result.get("new_version_id"):
                return chunk_no + 1
        return last + 1

    def _write_calls(self, written: DataFrame, chunk_no: int) -> None:
        """MON6-8: one line for each row the model was asked about, and one for each failed answer."""
        if not self.model:
            return
        asked = written.filter(F.col("error_log").isNotNull() | (F.col("rationale") != "no services data"))
        kinds = F.when(F.col("error_log").isNotNull(), F.array(F.lit("small_model"), F.lit("failed"))) \
            .otherwise(F.array(F.lit("small_model")))
        outcome = F.when(F.col("error_log").isNotNull(), "failed").when(F.col("sector") == UNCLASSIFIED, UNCLASSIFIED) \
            .otherwise("placed")
        asked.select(F.col("processed_at").alias("ts"), F.col("company_number").alias("company_id"),
                     F.explode(kinds).alias("service"), outcome.alias("outcome")) \
            .write.mode("overwrite").parquet(os.path.join(self.store.calls_path, f"part={self.run_id}-{chunk_no}"))

    # -- a whole run --
    def run(self, chunks: int) -> DataFrame:
        """The queued chunks one after the other, from the first that is not done."""
        queue = self.spark.read.parquet(self._path("queue")) if chunks else None
        done = {r["chunk_no"] for r in self.ledger().select("chunk_no").collect()}
        chunk_no, ahead = 0, 1 if self.refresh else MOST_AHEAD
        while chunk_no < chunks:
            if chunk_no in done:
                chunk_no += 1
            elif self.model:
                self.step(queue.filter(F.col("chunk_no") == chunk_no).drop("chunk_no"), chunk_no)
                chunk_no += 1
            else:
                last = min(chunk_no + ahead, min((c for c in done if c > chunk_no), default=chunks), chunks) - 1
                after = self.steps(queue, chunk_no, last)
                refreshed = self.refresh and self.ledger_row(after - 1)["new_version_id"] is not None
                chunk_no, ahead = after, 1 if refreshed else min(2 * ahead, MOST_AHEAD)
        return self.ledger()

    def queue(self, rows: DataFrame, chunk: int) -> int:
        """Lay down the run's chunks once; a run that goes on keeps its own."""
        path = self._path("queue")
        if path_exists(self.spark, os.path.join(path, "_SUCCESS")):
            return queued_chunks(self.spark, path)
        return queue_chunks(rows, path, chunk)

    def stream(self, input_dir: str, schema, checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
        """STR1 on the patch log: files of companies with descriptions as they arrive, a step for each micro-batch.
        Companies that earlier steps or runs have placed are left out."""

        def process(batch: DataFrame, batch_id: int) -> None:
            if self.ledger_row(batch_id) is not None:
                return
            fresh = dedupe_first(batch).persist()
            known = self.store.current(before=self.patch_batch(batch_id)) \
                .join(fresh.select("company_number"), "company_number", "left_semi")
            self.step(pending(fresh, known), batch_id)
            fresh.unpersist()

        query = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(input_dir) \
            .writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.ledger()
