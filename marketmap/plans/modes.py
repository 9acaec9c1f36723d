"""The tool's entry points as compositions of DataFrame jobs.

``discover`` builds the first taxonomy from a sticky, stratified sample;
``classify`` places every pending company and checks the refresh trigger;
``refresh`` adds sub-sectors for the gap (never renaming a sector) and
reclassifies the cleared rows; ``status``, ``history``, ``export`` and
``retry_failed`` complete the set.

State lives in a :class:`ResearchStore`: an append-only patch log
partitioned by ``batch_id`` plus the version table, both under the shared
checkpoint folder. The driver only takes one-row decisions (next batch id,
latest version, did the gate pass, did the trigger fire).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmap.constants import (
    CHECKPOINT_EVERY,
    EXPECTED_SECTORS,
    INSUFFICIENT_DATA,
    REFRESH_EVERY,
    REFRESH_UNCLASSIFIED_THRESHOLD,
    REFRESH_WINDOW,
    SAMPLE_SEED,
    SAMPLE_SIZE,
    UNCLASSIFIED,
)
from marketmap.operators import classify as K
from marketmap.operators import domains as D
from marketmap.operators import monitor as M
from marketmap.operators import pages as P
from marketmap.operators import refresh as R
from marketmap.operators import retry as RT
from marketmap.operators import sampling as SM
from marketmap.operators import services as V
from marketmap.operators import taxonomy as T
from marketmap.operators.partitioning import attach_one_row
from marketmap.operators.model import Model
from marketmap.session import list_dirs, path_exists, state_root
from marketmap.sources import export as X
from marketmap.sources import state as S
from marketmap.sources import taxonomy_store as TS
from marketmap.streaming.rollout import CALLS, Rollout


CLASSIFICATION_COLUMNS = ["sector", "sub_sector", "classification_confidence", "rationale",
                          "keywords", "taxonomy_version_id"]


class ResearchStore:
    """Patch log + version table under one root (default: the shared checkpoint folder)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or state_root(spark, "marketmap")
        self.patches = os.path.join(self.root, "patches")
        self.versions = os.path.join(self.root, "versions")
        self.calls_path = os.path.join(self.root, "calls")

    # -- patch log --
    def _next_batch(self) -> int:
        ids = [int(d.split("=", 1)[1]) for d in list_dirs(self.spark, self.patches)
               if d.startswith("batch_id=")]
        return max(ids, default=0) + 1

    def append(self, rows: DataFrame, kind: str = S.FULL, stamp: bool = True) -> int:
        """Write ``rows`` as one patch batch (overwrite of its own partition)."""
        return self.append_at(rows, self._next_batch(), kind, stamp)

    def append_at(self, rows: DataFrame, b: int, kind: str = S.FULL, stamp: bool = True) -> int:
        """Write ``rows`` as patch batch ``b``; written again, it replaces itself."""
        patches = S.make_patches(rows, b, kind, stamp=stamp) if kind == S.FULL \
            else S.flag_patches(rows, b)
        patches.write.mode("overwrite").parquet(os.path.join(self.patches, f"batch_id={b}"))
        return b

    def batch(self, b: int) -> DataFrame:
        """The rows of patch batch ``b``."""
        return self.spark.read.parquet(os.path.join(self.patches, f"batch_id={b}"))

    def _base(self) -> int:
        """First batch of the live log (the last compaction), 0 when never compacted."""
        marker = os.path.join(self.root, "_base")
        if not path_exists(self.spark, marker):
            return 0
        return self.spark.read.json(marker).agg(F.max("base")).first()[0]

    def current(self, before: int | None = None) -> DataFrame:
        """The newest row of each company, as of the patches below ``before`` when given."""
        if not path_exists(self.spark, self.patches):
            return S.as_state_row(self.spark.createDataFrame([], "company_number string"))
        log = self.spark.read.parquet(self.patches)
        base = self._base()
        if base:
            log = log.filter(F.col("batch_id") >= base)  # partition pruning
        if before is not None:
            log = log.filter(F.col("batch_id") < before)
        return S.latest(log.drop("batch_id"))

    def compact(self) -> int:
        """Write the current state as one full batch and start the live log there.

        Batches before it are no longer read (and may be deleted). If the job
        dies before the marker is written, the extra batch is just one more
        full patch per key, so the state is unchanged.
        """
        b = self._next_batch()
        snap = S.make_patches(self.current(), b, S.FULL)
        snap.write.mode("overwrite").parquet(os.path.join(self.patches, f"batch_id={b}"))
        self.spark.createDataFrame([(b,)], "base int").write.mode("overwrite") \
            .json(os.path.join(self.root, "_base"))
        return b

    def calls(self) -> DataFrame:
        """MON6-8: the lines that runs with a model have logged."""
        if not path_exists(self.spark, self.calls_path):
            return self.spark.createDataFrame([], CALLS)
        return self.spark.read.schema(CALLS).parquet(os.path.join(self.calls_path, "*"))

    # -- taxonomy versions --
    def versions_df(self) -> DataFrame:
        return TS.read_versions(self.spark, self.versions)

    def latest_version(self) -> int | None:
        return self.versions_df().agg(F.max("version_id")).first()[0]

    def taxonomy(self, version: int) -> DataFrame:
        row = self.versions_df().filter(F.col("version_id") == version)
        doc = row.select(F.from_json("taxonomy_json", TS.TAXONOMY_TYPE).alias("d")) \
            .select("d.sectors")
        return T.flatten(doc)

    def save_taxonomy(self, flat: DataFrame, trigger: str, company_count: int,
                      change_log: str | None = None, notes: str = "") -> int:
        v = TS.append_version(self.spark, self.versions, TS.to_json_text(TS.nest(flat)),
                              company_count, trigger, change_log, notes)
        return v.first()["version_id"]


# ---- the per-company stages: domain -> scrape -> describe ----

def run_stages(state: DataFrame, companies: DataFrame, probes: DataFrame, hits: DataFrame,
               pages: DataFrame, describer=None, resume: bool = True) -> DataFrame:
    """Rows ready to upsert for ``companies``; finished stages are not redone.

    ``resume=False`` reruns everything from nothing (retry of errored rows).
    """
    base = companies.select("company_number", "company_name", "postcode")
    if resume:
        j = S.resume_join(base, state)
    else:
        j = base
        for c in S.STATE_COLUMNS:
            if c not in ("company_number",):
                j = j.withColumn(f"existing_{c}", F.lit(None).cast(S.STATE_TYPES[c]))
    need_domain = F.coalesce(F.col("existing_domain"), F.lit("")) == ""
    todo = j.filter(need_domain).select("company_number", "company_name", "postcode")
    found = D.resolve_domains(todo, probes, hits).filter(F.col("domain").isNotNull())
    j = j.join(found.select("company_number", F.col("domain").alias("_d"),
                            F.col("domain_confidence").alias("_dc"),
                            F.col("domain_method").alias("_dm")), "company_number", "left")
    domain = F.coalesce(F.when(~need_domain, F.col("existing_domain")), F.col("_d"))
    j = j.withColumn("domain", domain) \
        .withColumn("domain_confidence", F.when(~need_domain, F.col("existing_domain_confidence"))
                    .otherwise(F.col("_dc"))) \
        .withColumn("domain_method", F.when(~need_domain, F.col("existing_domain_method"))
                    .otherwise(F.col("_dm")))
    has_desc = F.coalesce(F.col("existing_services_description"), F.lit("")) != ""
    want = j.filter(F.col("domain").isNotNull() & ~has_desc).select("domain").distinct()
    sites = P.scrape(want, pages)
    described = V.extract_services(V.infer_services(sites, describer)) \
        .select(F.col("host").alias("_host"), "services", "specialisms", "status")
    sites = sites.select(F.col("host").alias("_host"), "raw_length").join(described, "_host")
    j = j.withColumn("_host", F.regexp_replace(F.col("domain"), "^/+", "")) \
        .join(sites, "_host", "left")
    fresh = ~has_desc & F.col("status").isNotNull()
    return j.select(
        "company_number", "company_name", "postcode", "domain", "domain_confidence",
        "domain_method",
        F.when(fresh, F.col("raw_length").cast("int"))
        .otherwise(F.col("existing_website_raw_text_length")).alias("website_raw_text_length"),
        F.when(has_desc, F.col("existing_services_description"))
        .otherwise(F.col("services")).alias("services_description"),
        F.when(has_desc, F.col("existing_specialisms"))
        .otherwise(F.col("specialisms")).alias("specialisms"),
        F.coalesce(F.col("existing_sampled_for_discovery"), F.lit(0)).alias("sampled_for_discovery"),
        # Earlier classification is carried, so re-running the stages over
        # classified rows does not blank their sector (a fixed quirk).
        *[F.col(f"existing_{c}").alias(c) for c in CLASSIFICATION_COLUMNS],
        V.assemble_errors(F.when(fresh & (F.col("status") == "rejected"),
                                 F.lit("services_extraction: None returned"))).alias("error_log"))


def _classification_patch(classified: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """CLS8: classification columns + the 7 carried stage columns + name/postcode."""
    cls = classified.select(
        "company_number", "sector", "sub_sector",
        F.col("confidence").alias("classification_confidence"), "rationale", "keywords",
        *(["error_log"] if "error_log" in classified.columns else []),
        F.lit(version).cast("int").alias("taxonomy_version_id"))
    keep = S.as_state_row(state).select("company_number", "company_name", "postcode")
    return K.carry_over(cls, state).join(keep, "company_number")


# ---- modes ----

def discover(store: ResearchStore, companies: DataFrame, probes: DataFrame, hits: DataFrame,
             pages: DataFrame, describer=None, sample_size: int = SAMPLE_SIZE,
             seed: int = SAMPLE_SEED, k: int = 20) -> int | None:
    """Sample, run the stages on the sample, cluster, refine batch after batch, validate and save a version.

    Without a usable description nothing is saved and the result is None. An invalid taxonomy is still saved, with the error count in the notes.
    """
    state = store.current()
    sample = SM.sticky_sample(companies, state, sample_size, seed)
    store.append(sample.select("company_number"), kind=S.FLAG)
    rows = run_stages(store.current(), sample, probes, hits, pages, describer) \
        .withColumn("sampled_for_discovery", F.lit(1))
    store.append(rows)
    eligible = V.eligible_services(store.current())
    if T.described_terms(eligible).isEmpty():
        return None
    flat, model = T.discover(eligible, k=k, seed=seed)
    flat = T.refine(flat, model, eligible).drop("cluster", "added").checkpoint(eager=True)
    n_errors = T.validate(flat).count()
    return store.save_taxonomy(flat, "initial", eligible.count(),
                               notes=f"validation_errors={n_errors}" if n_errors else "")


def rollout(store: ResearchStore, run_id: str, model: Model | None = None, window: int = REFRESH_WINDOW,
            threshold: float = REFRESH_UNCLASSIFIED_THRESHOLD, every: int = REFRESH_EVERY,
            auto_refresh: bool = True, expected: int = EXPECTED_SECTORS) -> Rollout:
    """The steps of a classify run over ``store`` (streaming/rollout.py)."""

    def again(trigger: str, tag: str, cleared: int, placed: int) -> dict:
        return refresh(store, trigger=trigger, expected=expected, tag=tag, batches=(cleared, placed))

    return Rollout(store, run_id, _classification_patch, again if auto_refresh else None, model, window, threshold, every)


def classify(store: ResearchStore, companies: DataFrame, probes: DataFrame, hits: DataFrame,
             pages: DataFrame, describer=None, limit: int | None = None,
             window: int = REFRESH_WINDOW, threshold: float = REFRESH_UNCLASSIFIED_THRESHOLD,
             every: int = REFRESH_EVERY, auto_refresh: bool = True, model: Model | None = None,
             chunk: int = CHECKPOINT_EVERY, run_id: str | None = None,
             expected: int = EXPECTED_SECTORS) -> dict:
    """Place every pending company, chunk after chunk, each by the newest taxonomy.

    The stages do not depend on the taxonomy, so they run for all pending rows in one job first.
    After each chunk the trigger is checked; the scheduled one counts the rows of this run since its
    last refresh. A run with nothing pending writes nothing and triggers nothing. A run that was
    interrupted goes on under its ``run_id``. A larger ``chunk`` suits a larger cluster.
    """
    version = store.latest_version()
    if version is None:
        raise RuntimeError("No taxonomy version yet: run discover first.")
    run_id = run_id or uuid.uuid4().hex
    started = path_exists(store.spark, os.path.join(store.root, "runs", run_id, "queue", "_SUCCESS"))
    if not started:
        state = store.current()
        todo = K.pending(companies, state, limit)
        if todo.isEmpty():
            return {"version": version, "processed": 0, "trigger": None, "refresh": None, "chunks": 0, "refreshes": []}
        needs = K.needs_services(todo, state).filter("needs_services")
        store.append(run_stages(state, needs, probes, hits, pages, describer))
        rows = S.as_state_row(store.current()).join(todo.select("company_number", "input_seq"), "company_number")
    run = rollout(store, run_id, model, window, threshold, every, auto_refresh, expected)
    chunks = run.queue(None if started else rows, chunk)
    steps = run.run(chunks).orderBy("chunk_no").collect()
    fired = [r for r in steps if r["trigger"]]
    last = fired[-1] if fired else None
    made = [r["new_version_id"] for r in steps if r["new_version_id"]]
    out = {"run_id": run_id, "version": steps[0]["version_id"], "processed": sum(r["processed"] for r in steps),
           "trigger": last["trigger"] if last else None, "refresh": None, "chunks": len(steps), "refreshes": made}
    if last is not None and auto_refresh:
        out["refresh"] = {"accepted": last["new_version_id"] is not None, "new_version_id": last["new_version_id"],
                          "reason": last["reason"]}
    return out


def run_summary(store: ResearchStore, top: int = 10) -> DataFrame:
    """The report at the end of a run: spend, counters and time from the call log, totals and largest sectors from
    the state; (section, item, value)."""
    calls, state = store.calls(), store.current()

    def lines(df: DataFrame, section: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.item", "p.value")

    spend = M.spend(calls)
    totals = state.agg(
        F.count(F.lit(1)).alias("total"), F.count("domain").alias("domain_found"),
        F.count_if(F.col("services_description").isNotNull()
                   & (F.col("services_description") != INSUFFICIENT_DATA)).alias("services_extracted"),
        F.count_if(F.col("sector").isNotNull() & (F.col("sector") != UNCLASSIFIED)).alias("classified"),
        F.count_if(F.col("sector") == UNCLASSIFIED).alias("unclassified"),
        F.count("error_log").alias("errored"))
    sectors = state.filter(F.col("sector").isNotNull()).groupBy("sector").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), "sector").limit(top)
    return (spend.select(F.lit("calls").alias("section"), F.col("service").alias("item"), F.col("calls").cast("double").alias("value"))
            .unionByName(spend.select(F.lit("gbp").alias("section"), F.col("service").alias("item"), F.col("gbp").alias("value")))
            .unionByName(lines(M.run_counters(calls), "run")).unionByName(lines(M.time_per_company(calls), "time"))
            .unionByName(lines(totals, "totals"))
            .unionByName(sectors.select(F.lit("sector").alias("section"), F.col("sector").alias("item"),
                                        F.col("n").cast("double").alias("value"))))


def refresh(store: ResearchStore, trigger: str = "manual", force: bool = False,
            dry_run: bool = False, min_support: int = 3,
            expected: int = EXPECTED_SECTORS, tag: str | None = None,
            batches: tuple[int, int] | None = None) -> dict:
    """Gate, save the refined taxonomy, clear the gap rows and reclassify them.

    Inside a run the version is marked with ``tag`` and the patches are written as ``batches`` (cleared, placed
    again): a replay finds its version, and its patches replace those of the first try."""
    spark = store.spark
    state = store.current(before=batches[0] if batches else None)
    mine = F.endswith(F.coalesce("notes", F.lit("")), F.lit(tag or "\0"))
    made = store.versions_df().filter(mine).agg(F.max("version_id")).first()[0]
    if made is not None:
        return _place_gap(store, state, made, store.versions_df().filter(F.col("version_id") < made)
                          .agg(F.max("version_id")).first()[0], batches)
    version = store.latest_version()
    if version is None:
        return {"accepted": False, "reason": "no current taxonomy in DB"}
    cur = store.taxonomy(version)
    vdf = spark.range(1).select(F.lit(version).cast("int").alias("version_id"))
    at_version = state.filter(F.col("taxonomy_version_id") == version)
    new_flat, log = T.refresh_by_gap(at_version, cur, min_support)
    gap = R.gap_rows(state, vdf)
    ctx = R.context_sample(state, vdf)
    facts = vdf.select(F.col("version_id").alias("latest_version"))
    for part in [cur.agg((F.count(F.lit(1)) > 0).alias("has_taxonomy")),
                 gap.agg(F.count(F.lit(1)).alias("n_gap")),
                 new_flat.agg(F.countDistinct("sector_pos").alias("n_new_sectors")),
                 T.validate(new_flat, expected).agg(F.count(F.lit(1)).alias("n_errors")),
                 T.diff(cur, new_flat).filter(F.col("change") == "lost")
                   .agg(F.count(F.lit(1)).alias("n_lost"))]:
        facts = attach_one_row(facts, part)
    d = R.refresh_decision(facts, force, dry_run, trigger).first()
    if not d["accepted"]:
        return {"accepted": False, "reason": d["reason"]}
    size = R.refresh_size(gap, ctx).first()
    log_json = T.change_log_json(log).first()["change_log"]
    new_version = store.save_taxonomy(new_flat.drop("added"), trigger, size["n_total"],
                                      change_log=log_json,
                                      notes=f"refresh from v{version}" + (f" in {tag}" if tag else ""))
    return _place_gap(store, state, new_version, version, batches)


def _place_gap(store: ResearchStore, state: DataFrame, new_version: int, version: int,
               batches: tuple[int, int] | None) -> dict:
    """RFR5-6: clear the UNCLASSIFIED rows of ``version`` and place them by the new one."""
    b = store._next_batch()
    cleared, placed = batches or (b, b + 1)
    gap_keys = state.filter((F.col("sector") == UNCLASSIFIED)
                            & (F.col("taxonomy_version_id") == version))
    store.append_at(S.clear_unclassified(gap_keys, version), cleared)
    state = store.current(before=placed)
    cohort = state.filter(F.col("sector").isNull() & F.col("taxonomy_version_id").isNull()
                          & F.col("services_description").isNotNull())
    result = K.reclassify(cohort, store.taxonomy(new_version))
    store.append_at(_classification_patch(result, state, new_version), placed)
    counts = {r["outcome"]: r["n"] for r in R.outcome_counts(result).collect()}
    return {"accepted": True, "new_version_id": new_version,
            "reclassified_n": counts.get("placed", 0),
            "still_unclassified_n": counts.get("unclassified", 0)}


def status(store: ResearchStore) -> DataFrame:
    v = store.latest_version()
    return M.status_report(store.current(), store.taxonomy(v) if v is not None else None,
                           versions=store.versions_df())


def history(store: ResearchStore) -> DataFrame:
    return TS.history(store.versions_df())


def export(store: ResearchStore, path: str) -> int:
    return X.write_export(store.current(), path)


def retry_failed(store: ResearchStore, probes: DataFrame, hits: DataFrame, pages: DataFrame,
                 describer=None) -> dict:
    """Clear the error and rerun every stage from nothing for errored rows;
    classify those that end with a usable description when a taxonomy exists.

    The result names the patch batches of the rerun (``first_batch`` up to ``end_batch``, not included), so
    :func:`retry_report` can compare the state on both sides at any later time."""
    first = store._next_batch()
    state = store.current(before=first)
    bad = RT.errored(state)
    n = bad.count()
    if n == 0:
        return {"retried": 0, "first_batch": None, "end_batch": None}
    last = store.append(S.clear_error(state, bad).join(bad.select("company_number"), "company_number",
                                                       "left_semi"))
    rows = run_stages(store.current(), bad, probes, hits, pages, describer, resume=False)
    last = store.append(rows)
    version = store.latest_version()
    if version is not None:
        state = store.current()
        usable = state.join(bad.select("company_number"), "company_number", "left_semi") \
            .filter(F.col("services_description").isNotNull()
                    & (F.col("services_description") != INSUFFICIENT_DATA))
        last = store.append(_classification_patch(K.reclassify(usable, store.taxonomy(version)),
                                                  state, version))
    return {"retried": n, "first_batch": first, "end_batch": last + 1}


def retry_report(store: ResearchStore, first_batch: int, end_batch: int | None = None) -> DataFrame:
    """RTY3: the outcome of the rerun that wrote batches ``first_batch`` up to ``end_batch`` (not included), each
    errored row as it was and as it is, from two as-of reads of the patch log."""
    return RT.retry_outcome(store.current(before=first_batch), store.current(before=end_batch))
