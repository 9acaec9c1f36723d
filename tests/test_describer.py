"""SVC5: the describer in column expressions against a plain Python one, on random and odd texts."""

import json
import random
import re
import time
from collections import Counter

import pytest

from marketmap.constants import INSUFFICIENT_DATA, TOKEN_STOP_WORDS
from marketmap.operators import services as V

SPACE = " \t\n\r\f"


def describe(text):
    if text is None or not text.strip(SPACE + "\v"):
        return INSUFFICIENT_DATA
    def words(s):
        return [w for w in re.findall("[a-z][a-z0-9]{3,}", s.lower()) if w not in TOKEN_STOP_WORDS]
    top = [w for w, _ in sorted(Counter(words(text)).items(), key=lambda x: (-x[1], x[0]))[:5]]
    sentences = re.split(f"(?<=[.!?])[{SPACE}]+", text.strip(SPACE))
    best = sorted(range(len(sentences)), key=lambda i: (-len(set(words(sentences[i])) & set(top)), i))[:2]
    return {"services": " ".join(sentences[i] for i in sorted(best)), "specialisms": top}


def answers(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "host long, text string").repartition(4)
    got = {r["host"]: r["raw"] for r in V.infer_services(rows, **kw).collect()}
    return [v if v == INSUFFICIENT_DATA else json.loads(v) for _, v in sorted(got.items())]


def test_describer_equals_plain_python(spark):
    rng = random.Random(5)
    vocabulary = ["pumps", "valves", "steel", "the", "and", "services", "x9ab", "a", "Boilers", "BOILERS", "ltd", "crème", "9lives"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", "!\n", "?\t\t", ", ", ".x"])
                     for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    texts += [None, "", " \t\n\v", ".", "a b c", "the and services", "one. two. three.", "beta alfa beta alfa",
              'Quote "x" \\ back\nslash sentence. Next one here.', "日本語 の テキスト。", "Tail sentence wins. x. y. pumps pumps pumps"]
    assert answers(spark, texts) == [describe(t) for t in texts]


def test_describer_reads_whole_long_texts(spark):
    """The best sentence stands at the end of 200,000 different and 200,000 equal words; no quadratic step."""
    long = " ".join(f"filler{i}" for i in range(200_000)) + ". " + "pumps " * 200_000 + ". Late pumps sentence"
    t0 = time.time()
    assert answers(spark, [long, "short text"]) == [describe(long), describe("short text")]
    assert time.time() - t0 < 60


def test_default_describer_runs_no_python(spark):
    plan = V.infer_services(spark.createDataFrame([("h", "t")], "host string, text string")) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "mapInPandas" not in plan.lower()


def test_model_describer_sees_every_text(spark):
    def model(texts):
        return texts.map(lambda t: json.dumps({"services": (t or "none").upper(), "specialisms": []}))

    got = answers(spark, ["abc", None, "def"], describer=model)
    assert [g["services"] for g in got] == ["ABC", "NONE", "DEF"]


@pytest.mark.parametrize("rows", [[], [("h", None)]])
def test_empty_inputs(spark, rows):
    out = V.extract_services(V.infer_services(spark.createDataFrame(rows, "host string, text string"))).collect()
    assert [r["status"] for r in out] == ["sentinel"] * len(rows)
