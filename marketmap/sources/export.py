"""Export of the research state (SRC5) and the JSON rendering of lists (CLS7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmap.constants import EXPORT_COLUMNS
from marketmap.sources.state import as_state_row


# A JSON text as strings, separators and everything between them.
_TOKEN = r'("(?:[^"\\]|\\.)*"|[^",:]+|[,:])'
_PLAIN = r"^[\x20-\x7E]*$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), 1)


def _spaced(token: Column) -> Column:
    return F.when(token.isin(",", ":"), F.concat(token, F.lit(" "))).otherwise(token)


def _ascii(text: Column) -> Column:
    """Characters beyond ASCII as \\uXXXX (two of them beyond the basic plane)."""
    def one(c):
        h = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(c.rlike(_PLAIN), c).otherwise(F.concat(
            F.lit("\\u"), F.substring(h, 1, 4),
            F.when(F.length(h) > 4, F.concat(F.lit("\\u"), F.substring(h, 5, 4))).otherwise("")))

    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    return F.when(text.rlike(_PLAIN), text).otherwise(F.array_join(F.transform(chars, one), ""))


def py_json_text(json_text: Column) -> Column:
    """Compact JSON text as Python's json.dumps writes it: ", " and ": ", ASCII only."""
    return _ascii(F.array_join(F.transform(_tokens(json_text), _spaced), ""))


def py_repr_text(json_text: Column) -> Column:
    """Compact JSON text as Python's str() prints the value it stands for."""
    def one(t):
        inner = F.substring(t, 2, F.length(t) - 2)
        quoted = F.when(inner.contains("'") & ~inner.contains('\\"'), t).otherwise(F.concat(
            F.lit("'"), F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("'"), F.lit("\\'")),
            F.lit("'")))
        rest = t
        for json_word, word in (("true", "True"), ("false", "False"), ("null", "None")):
            rest = F.regexp_replace(rest, rf"\b{json_word}\b", word)
        return F.when(t.startswith('"'), quoted).when(t.isin(",", ":"), _spaced(t)).otherwise(rest)

    return F.array_join(F.transform(_tokens(json_text), one), "")


def py_json_list(arr: Column) -> Column:
    """A string array as Python's json.dumps writes it: '["a", "b"]'; NULL stays NULL.

    An element that is NULL prints as null. An empty array prints as '[]'.
    """
    return py_json_text(F.to_json(arr, {"ignoreNullFields": "false"}))


def export_rows(state: DataFrame) -> DataFrame:
    """SRC5: the 16 exported columns, lists as JSON text, ordered by name then key."""
    s = as_state_row(state)
    cols = [py_json_list(F.col(c)).alias(c) if c in ("specialisms", "keywords") else F.col(c)
            for c in EXPORT_COLUMNS]
    return s.select(*cols).orderBy("company_name", "company_number")


def write_export(state: DataFrame, path: str) -> int:
    """Write the export as CSV with a header; writes nothing when empty.

    The sort is a range-partitioned global sort, so part files are in order
    and no single task holds the whole table. Returns the row count.
    """
    out = export_rows(state)
    n = out.count()
    if n == 0:
        return 0
    out.write.mode("overwrite").option("header", True).csv(path)
    return n
