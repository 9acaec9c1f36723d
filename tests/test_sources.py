"""CSV ingest, keys, first-wins dedupe and the state patch log."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketmap.sources import companies as C
from marketmap.sources import state as S


def write(text: str, bom: bool = True) -> str:
    d = tempfile.mkdtemp(prefix="mm-csv-")
    p = os.path.join(d, "companies.csv")
    with open(p, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.write(text)
    return p


def test_csv_rules(spark):
    p = write('postcode,company_name,company_number\n'
              'RH4 1HF,STATION VIEW GARAGE (DORKING) LIMITED,05176110\n'
              ' ,"MULTI\nLINE LTD", \n'
              'S73 0UF,  ,00000001\n'
              'CT9 1UP,DUPLICATE FIRST,05176110\n'
              ',  HOWAT GROUP PLC ,\n')
    rows = {r["company_number"]: r for r in C.read_companies(spark, p).collect()}
    assert set(rows) == {"05176110", "slug:multiline", "slug:howat"}
    assert rows["05176110"]["company_name"] == "STATION VIEW GARAGE (DORKING) LIMITED"
    assert rows["slug:multiline"]["postcode"] is None
    assert rows["slug:howat"]["company_name"] == "HOWAT GROUP PLC"


def test_missing_name_column(spark):
    p = write("company_number,postcode\n1,RH4 1HF\n")
    with pytest.raises(ValueError):
        C.read_companies_csv(spark, p)


def test_first_row_wins(spark):
    df = spark.createDataFrame([(3, "k", "c"), (1, "k", "a"), (2, "k", "b"), (1, "j", "x")],
                               "input_seq long, company_number string, company_name string")
    got = {r["company_number"]: r["company_name"] for r in C.dedupe_first(df).collect()}
    assert got == {"k": "a", "j": "x"}


def _state(spark):
    return spark.createDataFrame(
        [("1", "A", "d.com", "SECTOR", 1), ("2", "B", None, None, 0)],
        "company_number string, company_name string, domain string, sector string, "
        "sampled_for_discovery int")


def test_upsert_replaces_row_keeps_flag(spark):
    st = _state(spark)
    patch = spark.createDataFrame([("1", "A2", 0)], "company_number string, company_name string, "
                                  "sampled_for_discovery int")
    got = {r["company_number"]: r for r in S.upsert(st, patch).collect()}
    assert got["1"]["company_name"] == "A2"
    assert got["1"]["domain"] is None and got["1"]["sector"] is None  # absent -> NULL
    assert got["1"]["sampled_for_discovery"] == 1                      # sticky maximum
    assert got["2"]["company_name"] == "B"


def test_upsert_replay_is_idempotent(spark):
    st = _state(spark)
    patch = spark.createDataFrame([("2", "B2", 0)], "company_number string, company_name string, "
                                  "sampled_for_discovery int")
    once = sorted(map(tuple, S.upsert(st, patch).collect()))
    twice = sorted(map(tuple, S.upsert(S.upsert(st, patch), patch).collect()))
    assert once == twice


def test_flag_patches(spark):
    st = S.make_patches(_state(spark), 1)
    flags = S.flag_patches(spark.createDataFrame([("2",), ("9",)], "company_number string"), 2)
    got = {r["company_number"]: r for r in S.latest(st.unionByName(flags)).collect()}
    assert got["2"]["sampled_for_discovery"] == 1 and got["2"]["company_name"] == "B"
    assert got["9"]["sampled_for_discovery"] == 1 and got["9"]["company_name"] is None
    assert got["1"]["sector"] == "SECTOR"


def test_mark_sampled_and_clear_error(spark):
    st = _state(spark).withColumn("error_log", F.lit("scrape: timeout"))
    keys = spark.createDataFrame([("2",), ("3",)], "company_number string")
    got = {r["company_number"]: r["sampled_for_discovery"]
           for r in S.mark_sampled(st, keys).collect()}
    assert got == {"1": 1, "2": 1, "3": 1}
    cleared = {r["company_number"]: r["error_log"] for r in S.clear_error(st, keys).collect()}
    assert cleared == {"1": "scrape: timeout", "2": None}


def test_load_taxonomy_file(spark):
    import json

    from marketmap.operators import taxonomy as T
    from marketmap.sources import taxonomy_store as TS
    d = tempfile.mkdtemp(prefix="mm-tax-")
    p = os.path.join(d, "taxonomy.json")
    doc = {"sectors": [{"name": "Timber", "description": "wood",
                        "sub_sectors": [{"name": "Joinery", "description": "doors"}]}]}
    with open(p, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
    flat = T.flatten(TS.load_taxonomy(spark, p)).collect()
    assert [(r["sector"], r["sub_sector"], r["sub_description"]) for r in flat] == \
        [("Timber", "Joinery", "doors")]
    with pytest.raises(FileNotFoundError, match="Run `discover` mode first"):
        TS.load_taxonomy(spark, os.path.join(d, "missing.json"))


def test_export_empty_writes_nothing(spark):
    from marketmap.sources.export import write_export
    out = os.path.join(tempfile.mkdtemp(prefix="mm-exp-"), "out")
    empty = spark.createDataFrame([], "company_number string, company_name string")
    assert write_export(empty, out) == 0
    assert not os.path.exists(out)


def test_store_compaction_keeps_state(spark):
    from marketmap.plans.modes import ResearchStore
    store = ResearchStore(spark, tempfile.mkdtemp(prefix="mm-store-"))
    st = _state(spark)
    store.append(st, stamp=False)
    store.append(spark.createDataFrame([("1", "A2")], "company_number string, company_name string"),
                 stamp=False)
    store.append(spark.createDataFrame([("2",)], "company_number string"), kind=S.FLAG)
    before = sorted(map(tuple, store.current().collect()))
    base = store.compact()
    assert base == 4
    assert sorted(map(tuple, store.current().collect())) == before
    store.append(spark.createDataFrame([("3", "C")], "company_number string, company_name string"),
                 stamp=False)
    after = {r["company_number"]: r for r in store.current().collect()}
    assert set(after) == {"1", "2", "3"} and after["1"]["company_name"] == "A2"
    assert after["2"]["sampled_for_discovery"] == 1
