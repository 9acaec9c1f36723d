"""Service descriptions from model responses (SVC1-8).

Responses are loosely typed JSON. They are parsed to VARIANT and checked by
kind, so a number where a string belongs is rejected (``from_json`` would
quietly turn 5 into '5').
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmap.constants import ERROR_SEPARATOR, INSUFFICIENT_DATA, TOKEN_STOP_WORDS
from marketmap.functions.text import json_kind, strip_fences


def parse_response(raw) -> Column:
    """SVC1-2: fences removed, then JSON as VARIANT; invalid text is NULL, never an error."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.try_parse_json(strip_fences(raw))


def extract_services(df: DataFrame, raw: str = "raw") -> DataFrame:
    """SVC3-4: typed ``services`` / ``specialisms`` and a ``status``.

    status = ok | sentinel | rejected. An object needs a string ``services``;
    ``specialisms`` that is not a list becomes []. Text that is not an object
    but holds INSUFFICIENT_DATA (any case) becomes the sentinel.
    """
    v = parse_response(raw)
    d = df.withColumn("_v", v)
    is_obj = json_kind(F.col("_v")) == "object"
    svc_v = F.variant_get(F.col("_v"), "$.services", "variant")
    spec_v = F.variant_get(F.col("_v"), "$.specialisms", "variant")
    svc_ok = is_obj & (json_kind(svc_v) == "string")
    sentinel = ~is_obj.eqNullSafe(True) & F.upper(F.col(raw)).contains(INSUFFICIENT_DATA)
    empty = F.array().cast("array<string>")
    spec = F.when(json_kind(spec_v) == "array",
                  F.variant_get(F.col("_v"), "$.specialisms", "array<string>")).otherwise(empty)
    status = F.when(svc_ok, "ok").when(sentinel, "sentinel").otherwise("rejected")
    return d.select(
        *[c for c in df.columns],
        F.when(svc_ok, F.variant_get(F.col("_v"), "$.services", "string"))
        .when(sentinel, F.lit(INSUFFICIENT_DATA)).alias("services"),
        F.when(svc_ok, spec).when(sentinel, empty).alias("specialisms"),
        status.alias("status"))


def eligible_services(state: DataFrame) -> DataFrame:
    """SVC6: sampled rows with a usable description (feeds taxonomy discovery)."""
    return state.filter((F.col("sampled_for_discovery") == 1)
                        & F.col("services_description").isNotNull()
                        & (F.col("services_description") != INSUFFICIENT_DATA)) \
        .select("company_number", "company_name", "services_description")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def stage_due(rows: DataFrame) -> DataFrame:
    """SVC7: which stage each row still needs. Finished stages cost nothing."""
    has_domain = ~_blank("domain")
    return rows.select(
        "company_number",
        _blank("domain").alias("need_domain"),
        (has_domain & _blank("services_description")).alias("need_scrape"),
        (has_domain & _blank("services_description")).alias("need_describe"))


def assemble_errors(*messages: Column) -> Column:
    """SVC8: stage messages joined by ' | ' (NULLs skipped), NULL when none."""
    j = F.concat_ws(ERROR_SEPARATOR, *messages)
    return F.when(j == "", F.lit(None).cast("string")).otherwise(j)


# ---- SVC5: descriptions from site texts ----

Describer = Callable[[pd.Series], pd.Series]

N_TERMS, N_SENTENCES, MIN_TERM = 5, 2, 4
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
_TERM = f"[a-z][a-z0-9]{{{MIN_TERM - 1},}}"
_MARK = "\x01"


def _terms(text: Column) -> Column:
    """Content words of a text in order, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(TOKEN_STOP_WORDS))


def top_terms(text: Column, n: int = N_TERMS) -> Column:
    """The ``n`` most frequent content words of the whole text, ties in alphabetical order.

    A fold over the sorted words that keeps the present run and the best ``n`` runs so far; the empty string at
    the end closes the last run.
    """
    run = F.struct(F.lit("").alias("word"), F.lit(0).alias("count"),
                   F.array().cast("array<struct<rank:int,word:string>>").alias("best"))

    def step(acc, w):
        ended = F.when(acc["count"] == 0, acc["best"]).otherwise(F.slice(F.array_sort(F.array_append(
            acc["best"], F.struct((-acc["count"]).alias("rank"), acc["word"].alias("word")))), 1, n))
        return F.when(acc["word"] == w, F.struct(acc["word"].alias("word"), (acc["count"] + 1).alias("count"),
                                                 acc["best"].alias("best"))) \
            .otherwise(F.struct(w.alias("word"), F.lit(1).alias("count"), ended.alias("best")))

    words = F.array_append(F.array_sort(_terms(text)), F.lit(""))
    return F.aggregate(words, run, step, lambda acc: F.transform(acc["best"], lambda b: b["word"]))


def lead_sentences(text: Column, terms: Column, n: int = N_SENTENCES) -> Column:
    """The ``n`` sentences of the whole text with most of the ``terms`` (ties: the earlier), in text order."""
    marked = F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\f")), SENTENCE_END, f"$1{_MARK}")
    scored = F.transform(F.split(marked, _MARK), lambda s, i: F.struct(
        (-F.size(F.array_intersect(_terms(s), terms))).alias("rank"), i.alias("at"), s.alias("text")))
    best = F.slice(F.array_sort(scored), 1, n)
    return F.array_join(F.transform(F.array_sort(F.transform(best, lambda b: F.struct(b["at"], b["text"]))),
                                    lambda b: b["text"]), " ")


def extract_descriptions(sites: DataFrame, key: str = "host", text: str = "text") -> DataFrame:
    """SVC5 without a model: a JSON response per site text, built-in functions only, no shuffle.

    services = the two sentences of the whole text that hold most of its five most frequent content words;
    specialisms = those words. A null text or one of white space only answers INSUFFICIENT_DATA. A text
    without content words gives its first two sentences and no specialisms.
    """
    t = F.col("_t")
    # Two columns read the terms, so Spark computes them once a row and not inside the fold over sentences.
    rows = sites.select(key, F.col(text).alias("_t"), top_terms(F.col(text)).alias("_terms"))
    answer = F.to_json(F.struct(lead_sentences(t, F.col("_terms")).alias("services"),
                                F.col("_terms").alias("specialisms")))
    blank = t.isNull() | (F.btrim(t, F.lit(" \t\n\r\f\v")) == "")
    return rows.select(key, F.when(blank, F.lit(INSUFFICIENT_DATA)).otherwise(answer).alias("raw"))


def infer_services(sites: DataFrame, describer: Describer | None = None,
                   key: str = "host", text: str = "text") -> DataFrame:
    """SVC5: run a describer over site texts, one Arrow batch at a time; :func:`extract_descriptions` without one.

    The describer is built once per task and sees whole pandas batches, so a
    real model client can batch its calls. Output: (key, raw) for SVC1-4.
    """
    if describer is None:
        return extract_descriptions(sites, key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "raw": describer(b[text]).astype("string")})

    key_type = sites.schema[key].dataType.simpleString()
    return sites.select(key, text).mapInPandas(run, f"{key} {key_type}, raw string")
