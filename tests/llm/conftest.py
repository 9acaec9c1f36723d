import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with a clashing extra column."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' as kept", "1 as component", "2 as digest", "'y' as `label`") if extra else df

    return make


#: Null, empty, blank, letterless and very long texts, repeats and ties.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "12345 !!"), (5, "word " * 30000), (6, "same text here again"),
       (7, "same text here again"), (7, "same text here again"), (None, "a row without an id here")]
