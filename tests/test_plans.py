"""Plan shapes the scale story depends on (checked on the final adaptive plans)."""

import pytest

from marketmap.operators import domains as D
from marketmap.plans.registry import QUERIES, load_all
from tests.conftest import SF_MID

load_all()


def final_plan(spark, name):
    df = QUERIES[name](spark, SF_MID)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_text_has_no_shuffle(spark):
    assert "Exchange" not in final_plan(spark, "page_text")


@pytest.mark.parametrize("name", ["stratified_sample", "classify_lexical", "site_text"])
def test_per_group_top_k_is_trimmed_before_shuffle(spark, name):
    assert "WindowGroupLimit" in final_plan(spark, name)


def test_sample_is_not_joined_with_itself(spark):
    plan = final_plan(spark, "stratified_sample")
    assert "LeftOuter" not in plan


def test_hits_of_guessed_companies_are_not_scored(spark):
    """A hit of a guessed company does not pass the join, and its link wins nothing."""
    companies = spark.createDataFrame([("1", "ALPHA BRAVO CHARLIE LTD", "AB1 2CD"), ("2", "DELTA ECHO FOXTROT LTD", None),
                                       ("3", "GOLF HOTEL INDIA", None)], "company_number string, company_name string, postcode string")
    probes = spark.createDataFrame([("alphabravocharlie.com", 200)], "host string, status_code int")
    link = "https://www.alphabravocharliedeltaechofoxtrot.com/x"
    hits = spark.createDataFrame([(c, q, 1, link) for c in "12" for q in (1, 2)] + [("3", 2, 1, "https://other.com"), ("9", 2, 1, link)],
                                 "company_number string, query_no int, rank int, link string")
    got = D.resolve_domains(companies, probes, hits)
    assert [tuple(r) for r in got.orderBy("company_number").collect()] == [
        ("1", "alphabravocharlie.com", "HIGH", "guess"),
        ("2", "alphabravocharliedeltaechofoxtrot.com", "MEDIUM", "serper"), ("3", None, None, None)]


def test_lexical_scorer_broadcasts_taxonomy_terms(spark):
    plan = final_plan(spark, "classify_lexical")
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan


def test_scans_are_pruned(spark):
    plan = final_plan(spark, "spend")
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = final_plan(spark, "errored")
    assert "ReadSchema: struct<doc_id:bigint>" in plan
