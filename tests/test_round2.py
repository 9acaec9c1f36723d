"""Cases of the second round: raw taxonomy JSON, JSON text of lists, idle runs, drift per company, page text."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketmap.functions.text import html_text
from marketmap.operators import classify as K
from marketmap.operators import taxonomy as T
from marketmap.operators.partitioning import top_k
from marketmap.plans.registry import QUERIES, load_all
from marketmap.streaming import incremental as S
from tests.conftest import SF_SMALL

load_all()


def errors(spark, text):
    df = spark.createDataFrame([(text,)], "taxonomy_json string")
    return sorted(r["error"] for r in T.validate_json(df, expected=1).collect())


@pytest.mark.parametrize("doc, want", [
    ("nonsense", ["'sectors' key missing or not a list"]),
    ('{"sectors": "oops"}', ["'sectors' key missing or not a list"]),
    ('["s"]', ["'sectors' key missing or not a list"]),
    ('{"sectors": ["s"]}', ["sector[0] is not a dict"]),
    ('{"sectors": [{"name": 5}]}', ["sector[0] has no name"]),
    ('{"sectors": [{"name": "A", "sub_sectors": {}}]}', ["sector 'A' sub_sectors is not a list"]),
    ('{"sectors": [{"name": "A", "sub_sectors": [1]}]}', ["sector 'A' sub_sector[0] not a dict"]),
    ('{"sectors": [{"name": "A", "sub_sectors": [{"name": 0}, {"name": 7}, {"name": 7}]}]}',
     ["duplicate sub-sector '7' in sector 'A'", "sector 'A' sub_sector[0] has no name"]),
    ('{"sectors": [{"name": "A"}]}', []),
    ('{"sectors": []}', ["expected exactly 1 sectors, got 0"]),
])
def test_taxonomy_shapes(spark, doc, want):
    assert errors(spark, doc) == want


@pytest.mark.parametrize("value", [[], [1, None, True], ["é😀\n\t\"\\"], [["a", {"b": ", : "}]], "x", 3, False, None,
                                   {"a": None, "b": ["it's", 'say "x"', "plain"]}])
def test_keywords_print_as_python_does(spark, value):
    df = spark.createDataFrame([(json.dumps({"k": value}),)], "j string")
    got = df.select(K.keywords_json(F.variant_get(F.try_parse_json("j"), "$.k", "variant")).alias("t")).first()["t"]
    assert got == (json.dumps(value) if isinstance(value, list) else str(value))


def test_drift_counts_a_company_once(spark):
    rows = [(str(i), s, t) for t, s in (("2024-01-01", "UNCLASSIFIED"), ("2024-01-02", "Farming")) for i in range(5)]
    df = spark.createDataFrame(rows, "company_number string, sector string, processed_at string") \
        .withColumn("processed_at", F.col("processed_at").cast("timestamp"))
    run = tempfile.mkdtemp(prefix="mm-drift-")
    src = S.write_files(df, os.path.join(run, "in"), 2, "processed_at")
    got = S.drift_last_w(spark, src, spark.read.parquet(src).schema, os.path.join(run, "out"),
                         os.path.join(run, "ckpt"), window=100).first()
    assert (got["unclassified"], got["total"]) == (0, 5)


@pytest.mark.parametrize("page, want", [
    ('<p title="a > b">x</p>y', "x y"),
    ("<nav-bar>kept</nav-bar> after", "kept after"),
    ("<a href='/?q=1&r=2>3'>go</a>", "go"),
    ("<p data-x=1=2>t</p>", "t"),
    ('<p title="open>text</p>end', "text end"),
])
def test_html_attributes(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(html_text("h")).first()[0] == want


def test_long_attributes(spark):
    page = "<img src='" + "a=b&" * 20000 + "'>" + "<p " + "x=1 " * 2000 + ">end</p>"
    assert spark.createDataFrame([(page,)], "h string").select(html_text("h")).first()[0] == "end"


def test_page_text_is_computed_once(spark):
    plan = QUERIES["site_text"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("noscript") == 1


def test_top_k_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(150)
    assert [r["v"] for r in top_k(df, [F.col("v")], 7).collect()] == list(range(7))


def test_sector_elements_are_not_gathered(spark):
    elements = ["5", '{"name": 5}', '{"name": "A", "sub_sectors": "none"}', '{"name": "A"}', '{"name": "B", "sub_sectors": ["s", {}]}']
    rows = spark.createDataFrame(list(enumerate(elements)), "sector_pos long, element string")
    text = spark.createDataFrame([('{"sectors": [' + ", ".join(elements) + "]}",)], "taxonomy_json string")
    want = sorted(map(str, T.validate_json(text, expected=4).collect()))
    assert sorted(map(str, T.validate_elements(rows, expected=4).collect())) == want and len(want) > 5
    plan = QUERIES["taxonomy_shape_errors"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
