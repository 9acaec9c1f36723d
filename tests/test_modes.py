"""discover -> classify -> refresh -> status / history / export / retry, end to end."""

import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketmap.operators import domains as D
from marketmap.operators import retry as RT
from marketmap.operators import taxonomy as T
from marketmap.plans import modes
from marketmap.plans.fixtures import Fixtures
from marketmap.sources import companies as C
from tests.conftest import SF_MID


def inputs(spark):
    fx = Fixtures(spark, SF_MID)
    companies = C.load_companies(fx.view("v_companies_raw"))
    seq = companies.select("company_number", F.col("input_seq").alias("company_seq"))
    hits = fx.view("v_search_hits").join(seq, "company_seq") \
        .select("company_number", "query_no", "rank", "link")
    probes = fx.view("v_host_probe")
    # Pages keyed by the domains the cascade finds (host i -> resolved domain i).
    found = D.resolve_domains(companies, probes, hits).filter(F.col("domain").isNotNull()) \
        .select("domain").distinct() \
        .withColumn("i", F.row_number().over(Window.orderBy("domain")))
    hosts = fx.view("v_site_pages").select("host").distinct() \
        .withColumn("i", F.row_number().over(Window.orderBy("host")))
    remap = hosts.join(found, "i").select("host", "domain")
    pages = fx.view("v_site_pages").join(remap, "host") \
        .select(F.col("domain").alias("host"), "path_ord", "status_code", "html")
    return companies, probes, hits, pages


def test_end_to_end(spark):
    companies, probes, hits, pages = inputs(spark)
    store = modes.ResearchStore(spark, tempfile.mkdtemp(prefix="mm-store-"))
    n = companies.count()
    v1 = modes.discover(store, companies, probes, hits, pages, sample_size=n + 1, k=5)
    assert v1 == 1
    state = store.current()
    assert state.filter("sampled_for_discovery = 1").count() == n
    flat = store.taxonomy(v1)
    assert T.validate(flat, expected=5).count() == 0
    assert state.filter(F.col("services_description").isNotNull()).count() > 0

    out = modes.classify(store, companies, probes, hits, pages, auto_refresh=False)
    state = store.current()
    assert state.count() == n
    assert state.filter(F.col("sector").isNull()).count() == 0
    placed = state.filter(F.col("sector") != "UNCLASSIFIED").select("sector", "sub_sector")
    assert placed.join(T.sub_sectors(flat).select("sector", "sub_sector"),
                       ["sector", "sub_sector"], "left_anti").count() == 0
    assert out["version"] == 1

    # Nothing pending any more: a rerun classifies nothing new.
    before = state.count()
    batches = set(os.listdir(store.patches))
    idle = modes.classify(store, companies, probes, hits, pages, auto_refresh=False, every=1)
    assert idle["processed"] == 0 and idle["trigger"] is None
    assert store.current().count() == before and set(os.listdir(store.patches)) == batches

    r = modes.refresh(store, trigger="manual", expected=5)
    assert r["accepted"], r
    assert r["new_version_id"] == 2
    assert T.diff(flat, store.taxonomy(2)).count() == 0      # no sector renamed
    assert T.validate(store.taxonomy(2), expected=5).count() == 0
    hist = [row["version_id"] for row in modes.history(store).collect()]
    assert hist == [1, 2]

    rep = {(x["section"], x["item"]): x for x in modes.status(store).collect()}
    assert rep[("summary", "total")]["n"] == n
    assert rep[("taxonomy", "latest_version")]["n"] == 2

    path = os.path.join(tempfile.mkdtemp(prefix="mm-export-"), "out")
    assert modes.export(store, path) == n
    assert spark.read.option("header", True).csv(path).count() == n

    failed = store.current().filter("error_log is not null").count()
    assert modes.retry_failed(store, probes, hits, pages)["retried"] == failed


def test_retry_report_compares_both_sides(spark):
    """A company whose site is found on the rerun is placed; one without a site is empty; others stay out."""
    companies, probes, hits, pages = inputs(spark)
    store = modes.ResearchStore(spark, tempfile.mkdtemp(prefix="mm-retry-"))
    n = companies.count()
    modes.discover(store, companies, probes, hits, pages, sample_size=n + 1, k=5)
    found = store.current().filter(F.col("services_description").isNotNull()).select("company_number").limit(3)
    lost = store.current().filter(F.col("domain").isNull()).select("company_number").limit(2)
    good, bad = ([r[0] for r in d.collect()] for d in (found, lost))
    assert len(good) == 3 and len(bad) == 2
    errored = store.current().filter(F.col("company_number").isin(good + bad)) \
        .withColumn("error_log", F.lit("scrape: timeout")).withColumn("domain", F.lit(None).cast("string")) \
        .withColumn("services_description", F.lit(None).cast("string"))
    store.append(errored)
    done = modes.retry_failed(store, probes, hits, pages)
    assert done["retried"] == 5 and done["end_batch"] > done["first_batch"]
    report = {r["company_number"]: r for r in
              modes.retry_report(store, done["first_batch"], done["end_batch"]).collect()}
    assert set(report) == set(good + bad)
    for c in good:
        assert report[c]["outcome"] in ("placed", "unclassified") and report[c]["domain_changed"]
        assert report[c]["was_error"] == "scrape: timeout" and report[c]["now_error"] is None
    assert {report[c]["outcome"] for c in bad} == {"empty"}
    # A later change of the state does not change the report.
    store.append(errored)
    again = modes.retry_report(store, done["first_batch"], done["end_batch"])
    assert {r["company_number"]: r for r in again.collect()} == report
    assert RT.retry_counts(again).agg(F.sum("n")).first()[0] == 5
