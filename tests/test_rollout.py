"""A classify run in chunks: refresh inside the run, replays, and a user's model."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketmap.operators.model import ResponseLog, classify_with_model
from marketmap.plans import modes
from marketmap.streaming.rollout import Rollout

SECTORS = {"Roofing": ["slates", "gutters"], "Baking": ["bread", "pastry"]}
WORDS = {"slates": "we fix slates roofing", "gutters": "gutters and roofing", "bread": "we bake bread baking",
         "drones": "drones survey fix mapping"}


def flat_of(spark):
    rows = [(i, s, None, j, b, None) for i, (s, subs) in enumerate(SECTORS.items()) for j, b in enumerate(subs)]
    return spark.createDataFrame(rows, "sector_pos int, sector string, sector_description string, sub_pos int, "
                                       "sub_sector string, sub_description string")


@pytest.fixture
def store(spark, tmp_path):
    s = modes.ResearchStore(spark, str(tmp_path / "store"))
    s.save_taxonomy(flat_of(spark), "initial", 0)
    return s


def state_rows(store, kinds, saved=True):
    """Companies with descriptions, in the state where ``saved``: ``kinds[i]`` names the text of company i."""
    rows = [(f"{i:08d}", f"Company {i}", "LS1 2AB", WORDS.get(k, k), i) for i, k in enumerate(kinds)]
    df = store.spark.createDataFrame(rows, "company_number string, company_name string, postcode string, "
                                           "services_description string, input_seq long")
    if saved:
        store.append(df.drop("input_seq"))
    return df


def stages(spark):
    return (spark.createDataFrame([], "host string, status_code int"),
            spark.createDataFrame([], "company_number string, query_no int, rank int, link string"),
            spark.createDataFrame([], "host string, path_ord int, status_code int, html string"))


# Roofers and bakers first; from the 2nd chunk of 10 on half the companies fly drones.
DRIFT = ["slates", "bread"] * 5 + ["drones", "bread"] * 10


def settings(**kw):
    return {"chunk": 10, "window": 10, "threshold": 0.3, "every": 10 ** 6, "expected": 2, **kw}


def test_refresh_inside_a_run(spark, store):
    companies = state_rows(store, DRIFT)
    out = modes.classify(store, companies, *stages(spark), run_id="r", **settings())
    assert out["processed"] == 30 and out["chunks"] == 3 and out["refreshes"] == [2]
    run = modes.rollout(store, "r")
    steps = {r["chunk_no"]: r for r in run.ledger().collect()}
    assert [steps[i]["version_id"] for i in range(3)] == [1, 1, 2]
    assert [steps[i]["trigger"] for i in range(3)] == [None, "unclassified_threshold", None]
    assert steps[1]["new_version_id"] == 2 and steps[1]["unclassified"] == 5
    state = {r["company_number"]: r for r in store.current().collect()}
    # Rows before the drift keep their version; the gap and all later rows carry the new one and are placed.
    versions = [state[f"{i:08d}"]["taxonomy_version_id"] for i in range(30)]
    assert versions[:10] == [1] * 10 and set(versions[20:]) == {2}
    assert all(state[f"{i:08d}"]["taxonomy_version_id"] == 2 for i in range(10, 30, 2))
    assert all(r["sector"] not in (None, "UNCLASSIFIED") for r in state.values())
    names = {r["sub_sector"] for r in store.taxonomy(2).collect()}
    assert "Drones" in names and {"slates", "bread"} <= names
    # A step opens its chunk and the step before, not the run's earlier patches or chunks.
    queue = spark.read.parquet(run._path("queue")).filter("chunk_no = 2")
    assert len(queue.inputFiles()) == 3 and "PartitionFilters: [isnotnull(chunk_no" in \
        queue._jdf.queryExecution().executedPlan().toString()
    assert queue.count() == 10 and run._tail(2).count() == 10


def test_scheduled_refresh_counts_from_the_last_one(spark, store):
    companies = state_rows(store, (["drones"] + ["bread"] * 9) * 3)
    out = modes.classify(store, companies, *stages(spark), run_id="s", **settings(every=20, threshold=2.0))
    steps = sorted(modes.rollout(store, "s").ledger().collect(), key=lambda r: r["chunk_no"])
    assert [r["rows_since_refresh"] for r in steps][:2] == [10, 20] and steps[1]["trigger"] == "scheduled"
    made = steps[1]["new_version_id"] is not None
    assert steps[2]["rows_since_refresh"] == (10 if made else 30) and out["processed"] == 30


def test_replayed_step_refreshes_once(spark, store, tmp_path):
    companies = state_rows(store, DRIFT[:20])
    modes.classify(store, companies, *stages(spark), run_id="r", **settings())
    want = sorted(map(tuple, store.current().drop("processed_at").collect()), key=str)
    run = modes.rollout(store, "r", window=10, threshold=0.3, every=10 ** 6, expected=2)
    # The new version was saved, but neither the step's ledger row nor its patches came about: the same step runs again.
    empty = spark.createDataFrame([], store.batch(run.patch_batch(1)).schema)
    (tmp_path / "store" / "runs" / "r" / "ledger" / "step=1" / "_SUCCESS").unlink()
    for k in (0, 1, 2):
        empty.write.mode("overwrite").parquet(f"{store.patches}/batch_id={run.patch_batch(1, k)}")
    out = modes.classify(store, companies, *stages(spark), run_id="r", **settings())
    assert store.latest_version() == 2 and out["refreshes"] == [2]
    assert sorted(map(tuple, store.current().drop("processed_at").collect()), key=str) == want


def test_stream_of_files_refreshes_and_leaves_placed_rows(spark, store, tmp_path):
    rows = state_rows(store, DRIFT, saved=False)
    source = str(tmp_path / "in")
    for i in (0, 1, 2, 0):
        rows.filter(F.floor(F.col("input_seq") / 10) == i).coalesce(1).write.mode("append").parquet(source)
    run = modes.rollout(store, "f", window=10, threshold=0.3, every=10 ** 6, expected=2)
    steps = sorted(run.stream(source, rows.schema, str(tmp_path / "ck")).collect(), key=lambda r: r["chunk_no"])
    assert [(r["processed"], r["version_id"]) for r in steps] == [(10, 1), (10, 1), (10, 2), (0, 2)]
    assert store.current().filter("sector = 'UNCLASSIFIED' or sector is null").count() == 0


def _outcome(store, run_id, chunks):
    """Ledger, the patches of every chunk, and the state in the order of the last W places."""
    run = modes.rollout(store, run_id)
    patches = [sorted(map(str, store.batch(run.patch_batch(i)).drop("processed_at", "seq").collect())) for i in range(chunks)]
    newest = store.current().orderBy(F.col("processed_at").desc_nulls_last(), "company_number")
    return (sorted(map(tuple, run.ledger().collect())), patches,
            list(map(str, newest.drop("processed_at").collect())), sorted(map(str, run._tail(chunks - 1).drop("processed_at").collect())))


def _runs_ahead_and_step_by_step(spark, tmp_path, monkeypatch, kinds, **kw):
    """Outcomes of one run with spans and one of single chunks, and the placements of the first."""
    out, placed = [], []
    place = Rollout._placed
    for ahead in (1024, 1):
        monkeypatch.setattr("marketmap.streaming.rollout.MOST_AHEAD", ahead)
        store = modes.ResearchStore(spark, str(tmp_path / f"ahead{ahead}"))
        store.save_taxonomy(flat_of(spark), "initial", 0)
        rows = state_rows(store, kinds).unionByName(state_rows(store, kinds, saved=False).filter("input_seq = 3"))
        if ahead > 1:
            monkeypatch.setattr(Rollout, "_placed", lambda *a: placed.append(a[2]) or place(*a))
        run = modes.rollout(store, "r", expected=2, **kw)
        chunks = run.queue(rows, 5)
        run.run(chunks)
        monkeypatch.setattr(Rollout, "_placed", place)
        out.append(_outcome(store, "r", chunks))
    return *out, placed, chunks


def test_chunks_are_placed_ahead_in_one_job(spark, tmp_path, monkeypatch):
    kinds = ["slates", "drones", "bread", "INSUFFICIENT_DATA", "", "bread", "drones"] * 2
    ahead, single, placed, chunks = _runs_ahead_and_step_by_step(
        spark, tmp_path, monkeypatch, kinds, window=8, threshold=0.45, every=14, auto_refresh=False)
    assert ahead == single and chunks == 3
    assert placed == [0]
    assert {r[6] for r in ahead[0]} == {None, "unclassified_threshold", "scheduled"}


def test_interrupted_span_goes_on(spark, store, monkeypatch):
    companies = state_rows(store, DRIFT)
    keep = Rollout._write_ledger
    monkeypatch.setattr(Rollout, "_write_ledger", lambda self, rows: keep(self, rows) if rows[0][0] < 1 else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        modes.classify(store, companies, *stages(spark), run_id="r", **settings())
    monkeypatch.setattr(Rollout, "_write_ledger", keep)
    out = modes.classify(store, companies, *stages(spark), run_id="r", **settings())
    assert out["processed"] == 30 and out["chunks"] == 3 and out["refreshes"] == [2]
    steps = sorted(modes.rollout(store, "r").ledger().collect())
    assert [r["version_id"] for r in steps] == [1, 1, 2] and store.latest_version() == 2
    assert store.current().filter("sector = 'UNCLASSIFIED' or sector is null").count() == 0


# ---- a user's model ----

class Scripted:
    """Answers by company number; fails for a request that holds a listed company."""

    def __init__(self, path, fail=()):
        self.path, self.fail = path, set(fail)

    def __call__(self, rows, taxonomy_text):
        assert "SECTOR: Roofing" in taxonomy_text
        with open(self.path, "a") as f:
            f.write("".join(n + "\n" for n in rows["company_number"]))
        if self.fail & set(rows["company_number"]):
            raise TimeoutError("no answer")
        return pd.Series([self.answer(n) for n in rows["company_number"]])

    @staticmethod
    def answer(n):
        i = int(n)
        good = {"sector": "Baking", "sub_sector": "bread", "confidence": "HIGH", "rationale": "r", "keywords": ["a", 1]}
        return [json.dumps(good), "```json\n" + json.dumps(good | {"sub_sector": "cakes"}) + "\n```", "not json", None,
                json.dumps({"sector": "UNCLASSIFIED", "sub_sector": "x", "confidence": "MEDIUM"}),
                json.dumps(good | {"sector": 5})][i % 6]


def test_model_answers_are_checked(spark, store, tmp_path):
    rows = state_rows(store, ["bread"] * 12 + ["INSUFFICIENT_DATA", ""])
    state = store.current()
    log = ResponseLog(spark, str(tmp_path / "log"))
    asked = tmp_path / "asked"
    got = {int(r["company_number"]): r for r in classify_with_model(
        state, flat_of(spark), 1, Scripted(str(asked)), log).collect()}
    assert len(got) == rows.count()
    for i in range(12):
        r = got[i]
        want = [("Baking", "bread", "HIGH", None), ("UNCLASSIFIED", None, "LOW", None)] + \
            [(None, None, None, "classify: LLM returned nothing")] * 2 + \
            [("UNCLASSIFIED", None, "MEDIUM", None), ("UNCLASSIFIED", None, "LOW", None)]
        assert (r["sector"], r["sub_sector"], r["confidence"], r["error_log"]) == want[i % 6], i
    assert got[0]["keywords"] == ["a", "1"] and got[4]["rationale"] == ""
    assert all(got[i]["rationale"] == "no services data" and got[i]["sector"] == "UNCLASSIFIED" for i in (12, 13))
    assert sorted(asked.read_text().split()) == [f"{i:08d}" for i in range(12)]


def test_rerun_asks_only_for_unanswered_rows(spark, store, tmp_path):
    companies = state_rows(store, ["bread"] * 30)
    asked = tmp_path / "asked"
    failing = Scripted(str(asked), fail=[f"{i:08d}" for i in range(20, 30)])
    out = modes.classify(store, companies, *stages(spark), model=failing, run_id="m", **settings(threshold=2.0))
    assert out["processed"] == 30
    state = {int(r["company_number"]): r for r in store.current().collect()}
    assert all(state[i]["error_log"] for i in range(20, 30)) and state[0]["sector"] == "Baking"
    first = asked.read_text().split()
    assert len(first) == 30
    # The same rows again at the same version: only the 10 of the failed calls and the 6 that had no answer.
    log = ResponseLog(spark, f"{store.root}/responses")
    sound = Scripted(str(asked))
    classify_with_model(store.current(), store.taxonomy(1), 1, sound, log).collect()
    again = asked.read_text().split()[30:]
    silent = {f"{i:08d}" for i in range(20) if i % 6 == 3}
    assert set(again) == silent | {f"{i:08d}" for i in range(20, 30)} and len(again) == len(set(again))
    calls = {r["service"]: r["count"] for r in store.calls().groupBy("service").count().collect()}
    errors = sum(1 for r in state.values() if r["error_log"])
    assert calls == {"small_model": 30, "failed": errors}
    report = {(r["section"], r["item"]): r["value"] for r in modes.run_summary(store).collect()}
    assert report["calls", "small_model"] == 30 and report["run", "errors"] == errors
    assert report["totals", "total"] == 30 and report["totals", "errored"] == errors
    assert report["gbp", "total"] == pytest.approx(30 * 0.001)
    assert report["sector", "Baking"] == sum(1 for r in state.values() if r["sector"] == "Baking")
