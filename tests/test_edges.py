"""Edge set: half-even quotas, empty inputs, a window not yet full, the CLI surface."""

from pyspark.sql import functions as F

from marketmap.operators import monitor as M
from marketmap.operators import sampling as SM
from marketmap.sources.state import as_state_row


def test_quota_halves_round_to_even(spark):
    # Areas B (1 row) and W (3 rows), n = 2: quotas 2*(1/4) = 0.5 -> 0 and 2*(3/4) = 1.5 -> 2.
    rows = [("1", "B1 1AA"), ("2", "W1 1AA"), ("3", "W2 1AA"), ("4", "W3 1AA")]
    df = spark.createDataFrame(rows, "company_number string, postcode string")
    got = SM.stratified_sample(df, 2).groupBy("area").count().collect()
    assert {r["area"]: r["count"] for r in got} == {"W": 2}


def test_empty_inputs(spark):
    empty = as_state_row(spark.createDataFrame([], "company_number string"))
    rep = {(r["section"], r["item"]): r for r in M.status_report(empty).collect()}
    assert rep[("summary", "total")]["n"] == 0
    assert rep[("share", "unclassified_pct")]["pct"] is None
    assert [r for r in rep if r[0] == "sector"] == []
    assert SM.stratified_sample(spark.createDataFrame([], "company_number string, postcode string"),
                                10).count() == 0
    assert M.rolling_unclassified(empty).first()["total"] == 0


def test_window_not_full_never_fires(spark):
    rows = [(str(i), "UNCLASSIFIED") for i in range(50)]
    st = spark.createDataFrame(rows, "company_number string, sector string") \
        .withColumn("processed_at", F.localtimestamp())
    t = M.refresh_trigger(M.rolling_unclassified(st, 1000), 10).first()
    assert t["total"] == 50 and t["unclassified"] == 50 and t["trigger"] is None
    t = M.refresh_trigger(M.rolling_unclassified(st, 50), 10, window=50).first()
    assert t["trigger"] == "unclassified_threshold"
    t = M.refresh_trigger(M.rolling_unclassified(st, 50), 10000, window=50).first()
    assert t["trigger"] == "scheduled"


def test_cli_surface():
    from marketmap.__main__ import _parser
    p = _parser()
    for argv in (["status"], ["taxonomy-history"], ["export", "--output", "x"],
                 ["refresh-taxonomy", "--force", "--dry-run"],
                 ["classify", "--input", "c", "--probes", "p", "--hits", "h", "--pages", "g"],
                 ["discover", "--input", "c", "--probes", "p", "--hits", "h", "--pages", "g",
                  "--sample-size", "10"],
                 ["retry-failed", "--probes", "p", "--hits", "h", "--pages", "g"]):
        assert p.parse_args(argv).cmd == argv[0]


def test_stages_resume_and_retry(spark):
    from marketmap.plans.modes import run_stages
    state = spark.createDataFrame(
        [("1", "ACME LTD", "acme.co.uk", "HIGH", "guess", "makes things", "S", "sub", 1)],
        "company_number string, company_name string, domain string, domain_confidence string, "
        "domain_method string, services_description string, sector string, sub_sector string, "
        "sampled_for_discovery int")
    companies = spark.createDataFrame([("1", "ACME LTD", "RH4 1HF"), ("2", "BETA LTD", None)],
                                      "company_number string, company_name string, postcode string")
    probes = spark.createDataFrame([], "host string, status_code int")
    hits = spark.createDataFrame([], "company_number string, query_no int, rank int, link string")
    pages = spark.createDataFrame([], "host string, path_ord int, status_code int, html string")
    got = {r["company_number"]: r for r in
           run_stages(state, companies, probes, hits, pages).collect()}
    assert got["1"]["domain"] == "acme.co.uk" and got["1"]["domain_method"] == "guess"
    assert got["1"]["services_description"] == "makes things"
    assert got["1"]["sector"] == "S" and got["1"]["sub_sector"] == "sub"   # carried, not blanked
    assert got["1"]["sampled_for_discovery"] == 1
    assert got["2"]["domain"] is None and got["2"]["services_description"] is None
    again = {r["company_number"]: r for r in
             run_stages(state, companies, probes, hits, pages, resume=False).collect()}
    assert again["1"]["domain"] is None and again["1"]["sector"] is None   # retry starts from nothing
