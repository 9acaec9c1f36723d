"""Hand-worked expectations for the text rules (from the sample CSV rules)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marketmap.functions import text as X
from marketmap.sources.companies import fallback_key


def one(spark, col_fn, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(col_fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("name,slug,tokens,clean", [
    ("STATION VIEW GARAGE (DORKING) LIMITED", "stationviewgaragedorking",
     ["station", "view", "garage", "dorking"], "STATION VIEW GARAGE (DORKING)"),
    ("HOWAT GROUP PLC", "howat", ["howat"], "HOWAT"),
    ("E.SAUNDERS(MARGATE)LIMITED", "esaundersmargate", ["saunders", "margate"],
     "E.SAUNDERS(MARGATE)"),
    ("BAM SITE SOLUTIONS LIMITED", "bamsitesolutions", ["bam", "site", "solutions"],
     "BAM SITE SOLUTIONS"),
    ("C & B MECHANICAL SERVICES LIMITED", "cbmechanicalservices", ["mechanical"],
     "C & B MECHANICAL SERVICES"),
])
def test_name_rules(spark, name, slug, tokens, clean):
    assert one(spark, X.slug, name) == slug
    assert one(spark, X.name_tokens, name) == tokens
    assert one(spark, X.clean_name, name) == clean


@pytest.mark.parametrize("pc,sector,area", [
    ("RH4 1HF", "RH4 1", "RH"), ("S73 0UF", "S73 0", "S"), ("CT9 1UP", "CT9 1", "CT"),
    ("BR3 5QN", "BR3 5", "BR"), ("RH41HF", "RH4 1", "RH"), ("RH12", "RH1 2", "RH"),
    (" rh4 1hf ", "RH4 1", "RH"), ("12345", None, None), ("", None, None), (None, None, None),
])
def test_postcode_rules(spark, pc, sector, area):
    assert one(spark, X.postcode_sector, pc) == sector
    assert one(spark, X.postcode_area, pc) == area


def test_strip_is_python_strip(spark):
    for s in [" ACME LTD ", "\t x \n", "　y ", "plain"]:
        assert one(spark, X.py_strip, s) == s.strip()
        assert one(spark, X.collapse_ws, s) == " ".join(s.split())


def test_fallback_keys(spark):
    assert one(spark, fallback_key, "HOWAT GROUP PLC") == "slug:howat"
    want = "hash:" + hashlib.md5("LTD".encode()).hexdigest()[:16]
    assert one(spark, fallback_key, "LTD") == want
    long = "A" * 60 + " LIMITED"
    assert one(spark, fallback_key, long) == "slug:" + "a" * 40


@pytest.mark.parametrize("url,host,bare", [
    ("https://WWW.Example.co.uk/about?x=1", "example.co.uk", "example"),
    ("example.com/x", "example.com", "example"),
    ("http://user@www.a.com:8080/", "a.com", "a"),
    ("https://uk.acme.example.com/", "uk.acme.example.com", "uk"),
    ("", "", ""),
])
def test_hosts(spark, url, host, bare):
    assert one(spark, X.host, url) == host
    assert one(spark, X.bare_label, url) == bare


@pytest.mark.parametrize("host,hit", [
    ("uk.linkedin.com", True), ("service.gov.uk", True), ("mybing.com", True),
    ("example.com", False), ("acme.co.uk", False),
])
def test_directory_substring(spark, host, hit):
    assert one(spark, X.is_directory_host, host) is hit


def test_fences(spark):
    assert one(spark, X.strip_fences, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.strip_fences, '  ```\n[1]\n```  ') == "[1]"
    assert one(spark, X.strip_fences, "plain") == "plain"
