"""Classification by a user's model (CLS4 by hook, CLS5): batched requests and a response log.

A model is a function ``model(rows, taxonomy_text)`` of a pandas frame (company_number, company_name,
services_description, specialisms) that gives one raw answer a row (JSON text, or None for no answer). It is called for
batches of bounded size inside the tasks. Answers are logged by (company, taxonomy version) before they are
used, so a rerun or a replayed chunk asks only for what has no answer yet.

Rows without usable services are never asked (CLS3). No answer, or one that is no JSON object, is the CLS5
error; a request whose call raises leaves all its rows unanswered. Answers must name a sector and sub-sector of
the taxonomy verbatim (CLS6).
"""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmap.constants import CLASSIFY_MISSING_ERROR
from marketmap.functions.text import json_kind
from marketmap.operators.classify import no_data_rule, validate_proposals
from marketmap.operators.services import parse_response
from marketmap.operators.taxonomy import render_text
from marketmap.session import path_exists

Model = Callable[[pd.DataFrame, str], pd.Series]

#: Rows of one request.
REQUEST_ROWS = 100
ASKED = ["company_number", "company_name", "services_description", "specialisms"]
ANSWERS = "company_number string, raw string"
OUTCOME = ["company_number", "sector", "sub_sector", "confidence", "rationale", "keywords", "error_log"]


def ask(rows: DataFrame, model: Model, taxonomy_text: str, request_rows: int = REQUEST_ROWS) -> DataFrame:
    """(company_number, raw) of every row; raw is NULL where the model has no answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), request_rows):
                part = batch.iloc[a:a + request_rows].reset_index(drop=True)
                try:
                    raw = pd.Series(list(model(part, taxonomy_text)), dtype="object")
                    if len(raw) != len(part):
                        raise ValueError(f"{len(raw)} answers to {len(part)} rows")
                except Exception as e:  # a failed call leaves its rows unanswered (CLS5), it does not end the run
                    logging.getLogger(__name__).warning("request of %d rows failed: %s", len(part), e)
                    raw = pd.Series([None] * len(part), dtype="object")
                yield pd.DataFrame({"company_number": part["company_number"], "raw": raw})

    return rows.select(*ASKED).mapInPandas(run, ANSWERS)


class ResponseLog:
    """Answers by (company, version), append-only, one folder a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _version(self, version: int) -> str:
        return os.path.join(self.path, f"version={version}")

    def answers(self, version: int) -> DataFrame:
        """(company_number, raw): the first answer to each company at ``version``."""
        path = self._version(version)
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], ANSWERS)
        log = self.spark.read.schema(ANSWERS + ", asked_at timestamp_ntz").parquet(f"{path}/*")
        return log.groupBy("company_number").agg(F.min_by("raw", F.struct("asked_at", "raw")).alias("raw"))

    def append(self, answers: DataFrame, version: int) -> None:
        """Log the rows that have an answer. Each append is a folder of its own, whole once its job ends."""
        answers.filter("raw is not null").withColumn("asked_at", F.localtimestamp()) \
            .write.parquet(os.path.join(self._version(version), f"part-{uuid.uuid4().hex}"))


def proposals(answers: DataFrame) -> DataFrame:
    """Answers that are JSON objects as (company_number, sector, sub_sector, confidence, rationale, keywords)."""
    v = answers.withColumn("_v", parse_response("raw")).filter(json_kind(F.col("_v")) == "object")

    def text(name: str):
        return F.try_variant_get(F.col("_v"), f"$.{name}", "string").alias(name)

    rationale = F.coalesce(F.try_variant_get(F.col("_v"), "$.rationale", "string"), F.lit(""))
    words = F.try_variant_get(F.col("_v"), "$.keywords", "array<string>")
    return v.select("company_number", text("sector"), text("sub_sector"), text("confidence"), rationale.alias("rationale"),
                    F.coalesce(words, F.array().cast("array<string>")).alias("keywords"))


def outcomes(asked: DataFrame, answers: DataFrame, flat: DataFrame) -> DataFrame:
    """CLS5 and CLS6 over the rows that were asked: a verified place, or the error and no sector."""
    checked = validate_proposals(proposals(answers), flat).withColumn("_got", F.lit(True))
    return asked.select("company_number").join(checked, "company_number", "left").select(
        *OUTCOME[:-1], F.when(F.col("_got").isNull(), F.lit(CLASSIFY_MISSING_ERROR)).alias("error_log"))


def classify_with_model(rows: DataFrame, flat: DataFrame, version: int, model: Model, log: ResponseLog,
                        request_rows: int = REQUEST_ROWS) -> DataFrame:
    """One outcome a row of ``rows`` (ASKED columns, a key once): CLS3, CLS5 or a place verified by CLS6."""
    usable = rows.join(no_data_rule(rows).select("company_number"), "company_number", "left_anti")
    open_ = usable.join(log.answers(version).select("company_number"), "company_number", "left_anti")
    # A taxonomy's text is a bounded document (TAX4: 20 sectors of at most 20 sub-sectors).
    text = render_text(flat).first()["text"]
    log.append(ask(open_, model, text, request_rows), version)
    answers = log.answers(version).join(usable.select("company_number"), "company_number", "left_semi")
    none = no_data_rule(rows).withColumn("error_log", F.lit(None).cast("string")).select(*OUTCOME)
    return none.unionByName(outcomes(usable, answers, flat))
