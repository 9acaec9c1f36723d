import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from marketmap.llm import exact_dedup
from tests.llm.conftest import ODD


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_groups_of_odd_rows(docs_of):
    rows = ODD + [(20, "a  b"), (21, "a\tb"), (22, "a b"), (23, "a b"), (24, " a b")]
    assert got(exact_dedup.exact_groups(docs_of(rows))) == brute(rows)


def test_empty_table(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).count() == 0


def test_state_lives_on_across_batches(spark, docs_of, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    df = docs_of(rows, extra=False).repartition(6)
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    assert got(exact_dedup.exact_groups(spark.read.parquet(path), files_per_trigger=1)) == brute(rows)


def test_a_later_run_goes_on_from_the_state(spark, docs_of, tmp_path):
    landing, state, check = (str(tmp_path / n) for n in ("landing", "state", "check"))
    exact_dedup.landing_rows(docs_of([(5, "x"), (6, "y")])).write.parquet(landing)
    exact_dedup.digest_state(spark, landing, state, check)
    exact_dedup.landing_rows(docs_of([(2, "x"), (9, "z")])).write.mode("append").parquet(landing)
    exact_dedup.digest_state(spark, landing, state, check)
    rows = exact_dedup.current_state(spark, state).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == [(2, 2), (6, 1), (9, 1)]


def test_texts_that_share_a_digest_are_told_apart(docs_of, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.substring(c, 1, 1), n))
    rows = [(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs_of(rows)).collect()}
    assert out == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}
