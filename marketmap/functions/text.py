"""Per-row text rules as Catalyst column expressions (no Python per row).

Each function takes and returns a ``Column`` so it stays inside
whole-stage codegen wherever it is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketmap.constants import (
    DIRECTORY_DOMAINS,
    DROPPED_HTML_TAGS,
    SLUG_STRIP_WORDS,
    TOKEN_STOP_WORDS,
    VOID_HTML_TAGS,
)

# Characters Python's str.strip()/str.split() treat as white space.
PY_WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

_STRIP_WORDS_RE = r"(?U)\b(?:" + "|".join(SLUG_STRIP_WORDS) + r")\b"
_POSTCODE_RE = r"(?U)^([A-Z]{1,2}\d{1,2}[A-Z]?)\s*(\d)"
_AREA_RE = r"^([A-Z]{1,2})"
_SCHEMED_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set spelled out for btrim (which trims ends only: no regex scan).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Strip leading/trailing white space the way Python's str.strip() does."""
    return F.btrim(_c(c), F.lit(PY_WS_CHARS))


def collapse_ws(c) -> Column:
    """' '.join(s.split()): runs of white space to one space, ends trimmed."""
    return F.btrim(F.regexp_replace(_c(c), rf"{PY_WS}+", " "), F.lit(" "))


def blank_to_null(c) -> Column:
    c = _c(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


# ---- TXT1-3: company names ----

def strip_company_words(c) -> Column:
    """Upper-case and blank out the whole words HOLDINGS LIMITED GROUP LTD PLC LLP."""
    return F.regexp_replace(F.upper(_c(c)), _STRIP_WORDS_RE, " ")


def slug(c) -> Column:
    """TXT1: lower-case alphanumerics left after the company words are removed."""
    return F.regexp_replace(F.lower(strip_company_words(c)), "[^a-z0-9]", "")


def clean_name(c) -> Column:
    """TXT2: search name, company words out, white space collapsed, upper case."""
    return collapse_ws(strip_company_words(c))


def name_tokens(c) -> Column:
    """TXT3: [a-zA-Z0-9]+ runs of the lower-cased name, length >= 3, stop words out.

    Duplicates are kept (they score twice).
    """
    stop = F.array(*[F.lit(w) for w in TOKEN_STOP_WORDS])
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-zA-Z0-9]+)"), 1)
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


# ---- TXT4-5: postcodes ----

def _norm_postcode(c) -> Column:
    return F.upper(py_strip(c))


def postcode_sector(c) -> Column:
    """TXT4: '<outward> <first inward digit>' or NULL."""
    p = _norm_postcode(c)
    out = F.regexp_extract(p, _POSTCODE_RE, 1)
    digit = F.regexp_extract(p, _POSTCODE_RE, 2)
    return F.when(_c(c).isNull() | (out == ""), F.lit(None).cast("string")) \
        .otherwise(F.concat(out, F.lit(" "), digit))


def postcode_area(c) -> Column:
    """TXT5: one or two leading letters of the postcode, else NULL."""
    return F.when(_c(c).isNull(), F.lit(None).cast("string")) \
        .otherwise(blank_to_null(F.regexp_extract(_norm_postcode(c), _AREA_RE, 1)))


# ---- TXT6-8: hosts ----

def url_host(c) -> Column:
    """Lower-case host of a URL that carries a scheme; '' when it has none."""
    return F.lower(F.regexp_extract(_c(c), _SCHEMED_HOST_RE, 1))


def drop_www(c) -> Column:
    return F.regexp_replace(_c(c), r"^www\.", "")


def host(c) -> Column:
    """TXT6: host of a URL or bare host name, lower case, one leading 'www.' removed."""
    s = py_strip(c)
    s = F.when(F.instr(s, "://") > 0, s).otherwise(F.concat(F.lit("http://"), s))
    return drop_www(url_host(s))


def bare_label(c) -> Column:
    """TXT7: first label of the host ('' when there is no host)."""
    return F.substring_index(host(c), ".", 1)


DIRECTORY_RE = "(?:" + "|".join(d.replace(".", r"\.") for d in DIRECTORY_DOMAINS) + ")"


def is_directory_host(host_col) -> Column:
    """TXT8: the host contains any directory fragment (plain substring test)."""
    return _c(host_col).rlike(DIRECTORY_RE)


# ---- TXT9: HTML to text ----

# Noncharacters that mark where a tag begins and ends while a page is cut up.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"
# The rest of a tag: a quoted value after '=' may hold '>'.
_ATTRS = r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
# Scripts, styles and comments whole, any other tag by itself, in one left-to-right pass as an HTML tokenizer meets them.
_TOKEN_RE = (r"(?is)<(script|style)(?=[\s/>])" + _ATTRS + r">.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)"
             r"|</?[A-Za-z]" + _ATTRS + r">|<[!?][^>]*>|</>|</[^A-Za-z][^>]*>")
# Name of a start tag or '/name' of an end tag, for tags that open or close an element.
_NAME_RE = (r"(?is)^<(?!(?:script|style|" + "|".join(VOID_HTML_TAGS) + rf")[\s/>]|[^{_SHUT}]*/>{_SHUT})(/?[A-Za-z][^\s/>]*)")
# Elements that hold others and are dropped with all of them.
_DROPPED_TREES = [t for t in DROPPED_HTML_TAGS if t not in ("script", "style")]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _shown(page: Column, trees: Column) -> Column:
    """Text segments of a page outside dropped elements (``trees``: their names), in page order.

    The page is cut into segments, each a tag and the text after it. A fold over the tags keeps the open elements
    as '/inner/outer/': an end tag closes the nearest open element of its name and all inside it, so a dropped
    element that is never closed ends with its parent. The fold collects the ranges of segments that show.
    """
    return _let(F.split(F.regexp_replace(page, _TOKEN_RE, f"{_OPEN}$0{_SHUT}"), _OPEN, -1),
                lambda segments: _shown_segments(segments, trees))


def _shown_segments(segments: Column, trees: Column) -> Column:
    def name(segment: Column) -> Column:
        return F.lower(F.regexp_extract(segment, _NAME_RE, 1))

    tags = F.filter(F.transform(segments, lambda s, i: F.struct(i.alias("i"), name(s).alias("name"))),
                    lambda t: t["name"] != "")
    start = F.struct(F.lit("/").alias("open"), F.lit(-1).alias("below"), F.lit(0).alias("since"),
                     F.array().cast("array<struct<a:int,n:int>>").alias("shown"))

    def step(state: Column, tag: Column) -> Column:
        at = F.instr(state["open"], F.concat(tag["name"], F.lit("/")))
        ends = F.startswith(tag["name"], F.lit("/"))
        left = F.when(~ends, F.concat(F.lit("/"), tag["name"], state["open"])) \
            .when(at > 0, F.substring(state["open"], at + F.length(tag["name"]), F.length(state["open"]))) \
            .otherwise(state["open"])
        hides = (state["below"] < 0) & F.array_contains(trees, tag["name"])
        shows = (state["below"] >= 0) & (F.length(left) <= state["below"])
        seen = F.struct((state["since"] + 1).alias("a"), (tag["i"] - state["since"]).alias("n"))
        return F.struct(
            left.alias("open"),
            F.when(hides, F.length(state["open"])).when(shows, -1).otherwise(state["below"]).alias("below"),
            F.when(shows, tag["i"]).otherwise(state["since"]).alias("since"),
            F.when(hides, F.concat(state["shown"], F.array(seen))).otherwise(state["shown"]).alias("shown"))

    def finish(state: Column) -> Column:
        rest = F.struct((state["since"] + 1).alias("a"), (F.size(segments) - state["since"]).alias("n"))
        return F.when(state["below"] < 0, F.concat(state["shown"], F.array(rest))).otherwise(state["shown"])

    ranges = F.aggregate(tags, start, step, finish)
    shown = F.flatten(F.transform(ranges, lambda r: F.slice(segments, r["a"], r["n"])))
    return F.array_join(F.transform(shown, lambda s: F.substring_index(s, _SHUT, -1)), " ")


# Character references as HTML defines them; names that end without ';' are the legacy ones.
_REFERENCE_RE = r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[^\t\n\f <&#;]{1,32};?)"
_LEGACY_RE = "^&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# Numbers 0x80 to 0x9F mean the Windows characters of those bytes, where there are any.
_WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def _numeric(ref: Column) -> Column:
    """The character of '&#...;': U+FFFD where there is none, '' for control and noncharacters."""
    ten, sixteen = (F.regexp_extract(ref, p, 1) for p in ("^&#0*([0-9]*)", "^&#[xX]0*([0-9a-fA-F]*)"))
    is_hex = ref.rlike("^&#[xX]")
    n = F.when(is_hex & (F.length(sixteen) <= 6), F.conv(F.concat(F.lit("0"), sixteen), 16, 10).cast("int")) \
        .when(~is_hex & (F.length(ten) <= 7), F.concat(F.lit("0"), ten).cast("int")).otherwise(0x110000)
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd") \
        .when(n.between(0x80, 0x9F), F.get(F.array(*[F.lit(w) for w in _WINDOWS]), n - 0x80)) \
        .when((n.between(1, 0x1F) & ~n.isin(9, 10, 12, 13)) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
              | (n.bitwiseAND(0xFFFE) == 0xFFFE), "") \
        .otherwise(text)


def _reference(ref: Column, names: Column) -> Column:
    legacy = F.regexp_extract(ref, _LEGACY_RE, 1)
    return F.when(F.startswith(ref, F.lit("&#")), _numeric(ref)) \
        .otherwise(F.coalesce(F.element_at(names, F.substring(ref, 2, 40)),
                              F.concat(F.element_at(names, legacy), F.substring(ref, F.length(legacy) + 2, F.lit(40))),
                              ref))


def decode_references(c) -> Column:
    """Character references of a text decoded once: every HTML name, numbers, legacy names without ';'."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def put_in(text: Column, refs: Column, chars: Column) -> Column:
        decoded = F.concat(F.transform(refs, lambda r: F.element_at(chars, r)), F.array(F.lit("")))
        pieces = F.split(text, _REFERENCE_RE, -1)
        return F.array_join(F.zip_with(pieces, decoded, lambda piece, char: F.concat(piece, char)), "")

    def decode(text: Column, refs: Column) -> Column:
        # Each reference of a page is looked up once.
        chars = _let(F.array_distinct(refs), lambda kinds: F.map_from_arrays(
            kinds, F.transform(kinds, lambda r: _reference(r, names))))
        return F.when(F.size(refs) > 0, _let(chars, lambda m: put_in(text, refs, m))).otherwise(text)

    return _let(_c(c), lambda text: _let(F.regexp_extract_all(text, F.lit(_REFERENCE_RE), 0), lambda refs: decode(text, refs)))


def html_text(c) -> Column:
    """TXT9: visible text of an HTML page.

    Drops script/style/nav/footer/header/noscript elements (each ends with its end tag, or with its parent) and
    comments, turns every remaining tag into a separator, decodes character references and collapses white space.
    The noncharacters U+FDD0 and U+FDD1 are removed from the page.
    """
    def text(page: Column, trees: Column) -> Column:
        # Where no element can be dropped with others in it, tags need no nesting.
        tree_re = F.concat(F.lit("(?i)<(?:"), F.array_join(trees, "|"), F.lit(r")[\s/>]"))
        return F.when(F.rlike(page, tree_re), _shown(page, trees)).otherwise(F.regexp_replace(page, _TOKEN_RE, " "))

    names = F.array(*map(F.lit, _DROPPED_TREES))
    return collapse_ws(decode_references(_let(
        F.regexp_replace(_c(c), f"[{_OPEN}{_SHUT}]", ""), lambda page: _let(names, lambda trees: text(page, trees)))))


# ---- SVC1-4: model responses ----

def strip_fences(c) -> Column:
    """SVC1: trim, remove a leading ```json / ``` fence and a trailing ``` fence."""
    t = py_strip(c)
    t = F.regexp_replace(t, rf"^```(?:json)?{PY_WS}*", "")
    t = F.regexp_replace(t, rf"{PY_WS}*```$", "")
    return py_strip(t)


def variant_kind(v) -> Column:
    """Top-level JSON kind of a VARIANT: OBJECT, ARRAY, STRING, BIGINT ... or NULL."""
    s = F.schema_of_variant(_c(v))
    return F.when(_c(v).isNull(), F.lit(None).cast("string")) \
        .otherwise(F.regexp_extract(s, r"^([A-Z_]+)", 1))


def json_kind(v) -> Column:
    """Kind of a VARIANT value: object, array, string, number, boolean, null (or NULL)."""
    k = variant_kind(v)
    return (F.when(k == "OBJECT", "object").when(k == "ARRAY", "array")
            .when(k == "STRING", "string").when(k == "BOOLEAN", "boolean")
            .when(k == "VOID", "null").when(k.isNull(), F.lit(None).cast("string"))
            .otherwise("number"))
