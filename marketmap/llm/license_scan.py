"""Licence scan: canonical digests of entire texts, hash-joined to known licence digests.

A text is put into canonical form (case, punctuation, copyright lines and equivalent spellings
normalised away) and its SHA-256 is looked up among the digests of known licence texts. Two kinds
of unit are looked up: the whole document, and each whole line of it, so that a notice at the foot
of a document is found too. Built-in SQL functions only.

Edge cases: a null or empty text, or one that is empty once normalised (also one that holds only
copyright lines), matches nothing and has ``canonical_sha256`` null; repeated rows are reported one by
one; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and usual notices (identifier, text).
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
    "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_CONDITIONS_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n")
_CLAUSE_BSD3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.\n")
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
KNOWN_LICENSES = [
    ("MIT", _GRANT_MIT + ", subject to the following conditions:\n\nThe above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY_MIT),
    ("MIT", "MIT License\n\n" + _GRANT_MIT + ", subject to the following conditions:\n\nThe above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
     + _WARRANTY_MIT),
    ("MIT-0", _GRANT_MIT + ".\n\n" + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies.\n\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted.\n\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _CONDITIONS_BSD2 + _WARRANTY_BSD),
    ("BSD-3-Clause", _CONDITIONS_BSD2 + _CLAUSE_BSD3 + _WARRANTY_BSD),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
     "License."),
]
# Spellings that count as the same, on text that is already lower case words.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("copyright owner", "copyright holder"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("merchantable", "merchantability"), ("noncommercial", "non commercial"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("recognise", "recognize"), ("sub license", "sublicense"),
    ("whilst", "while"), ("http", "https"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Lines that name a copyright holder; they differ from copy to copy of one licence.
# (?d): only \n ends a line.
COPYRIGHT_LINE = r"(?md)^[ \t>#*/;-]*(copyright\b|\(c\)|©)[^\n]*$"
RIGHTS_LINE = r"(?md)^[ \t>#*/;-]*all rights reserved[.]?[ \t]*$"
# Every known text holds one of these, so a line without any cannot equal one.
STEMS = "licen[cs]|spdx|permission|redistribution"
# What is neither an ASCII letter or digit nor beyond Latin-1's controls is punctuation or space.
NOT_WORD = r"[^a-z0-9\x{a1}-\x{10ffff}]+"
_TYPOGRAPHIC = "‘’“”«»–—…·•"


def canonical(text: Column) -> Column:
    """Canonical form: words in lower case, one space between and around them; null for nothing."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    t = F.translate(F.translate(t, "\r", "\n"), _TYPOGRAPHIC, " " * len(_TYPOGRAPHIC))
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), RIGHTS_LINE, "")
    t = F.regexp_replace(t, NOT_WORD, " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.nullif(t, F.lit("  "))


def known_digests(spark: SparkSession, licenses=None) -> DataFrame:
    """(digest, license_id) of the known texts; one row per digest. A fixed list, so small by construction."""
    licenses = list(licenses or KNOWN_LICENSES)
    for _, text in licenses:
        if not re.search(STEMS, text.lower()):
            raise ValueError(f"a known licence text needs one of {STEMS}: {text[:60]}")
    known = spark.createDataFrame(licenses, "license_id string, text string")
    return known.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id") \
        .filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses=None) -> DataFrame:
    """doc_id, canonical_sha256, text_license (whole text equals a known one), n_notice_lines and
    notice_licenses (sorted distinct licences of the lines that equal a known text, comma-joined)."""
    known = known_digests(docs.sparkSession, licenses)
    by_digest = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("_known"))
    whole = docs.select("doc_id", "text", F.sha2(canonical(F.col("text")), 256).alias("digest")) \
        .join(F.broadcast(known.withColumnRenamed("license_id", "text_license")), "digest", "left")
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[\r\n]+"), lambda x: F.lower(x).rlike(STEMS))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at("_known", F.coalesce(
        F.sha2(canonical(x), 256), F.lit("")))), lambda x: x.isNotNull())
    # The known digests ride along as one map (a one-row side), so lines need no shuffle.
    return whole.crossJoin(F.broadcast(by_digest)).withColumn("_found", found) \
        .select("doc_id", F.col("digest").alias("canonical_sha256"), "text_license",
                F.size("_found").cast("bigint").alias("n_notice_lines"),
                F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notice_licenses"))


def _sql_canonical(text: str) -> str:
    sql = f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"
    sql = f"translate(translate({sql}, chr(13), chr(10)), '{_TYPOGRAPHIC}', '{' ' * len(_TYPOGRAPHIC)}')"
    for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
        sql = f"regexp_replace({sql}, '{pattern.replace('(?md)', '(?m)')}', '', 'g')"
    sql = f"' ' || trim(regexp_replace({sql}, '{NOT_WORD}', ' ', 'g'), ' ') || ' '"
    for a, b in SPELLINGS:
        sql = f"replace({sql}, ' {a} ', ' {b} ')"
    return f"nullif({sql}, '  ')"


def oracle_sql() -> str:
    """DuckDB text for ``scan_licenses`` of documents: digests by the same definition, looked up by joins."""
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN_LICENSES)
    return f"""
with known as (select sha256({_sql_canonical('t')}) digest, min(i) license_id
               from (values {known}) k(i, t) group by 1),
whole as (select doc_id, text, sha256({_sql_canonical('text')}) digest from documents),
lines as (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\r\n]+')) line from documents),
hits as (select l.doc_id, count(*) n, string_agg(distinct k.license_id, ',' order by k.license_id) ids
         from (select doc_id, sha256({_sql_canonical('line')}) digest from lines) l
         join known k using (digest) group by 1)
select w.doc_id, w.digest as canonical_sha256, k.license_id as text_license,
       coalesce(h.n, 0)::bigint as n_notice_lines, coalesce(h.ids, '') as notice_licenses
from whole w left join known k using (digest) left join hits h on h.doc_id = w.doc_id"""
