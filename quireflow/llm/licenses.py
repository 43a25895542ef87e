"""Licence scan by canonical digest (operator 3, DataFrame functions only).

A text and every known licence are brought to one canonical form: lower case,
no copyright lines, equivalent spellings united, punctuation and white space
collapsed.  The SHA-256 of the whole canonical text is looked up among the
digests of the known licences.

Defined results: a null or blank text has a null digest and no licence; repeated
rows each get their answer; of two known licences with one canonical form the
first name wins; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import table

#: Equivalent spellings, the second form is kept.
SPELLINGS = (
    ("licence", "license"),
    ("licensor s", "licensors"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
COPYRIGHT_LINE = r"(^|\n)[^\n]*(copyright +(\(c\)|©|[0-9]{4})|\(c\) +[0-9]{4}|© *[0-9]{4}|all rights reserved)[^\n]*"
SEPARATORS = r"[\p{P}\p{S}\p{Z}\x00-\x20]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licences: name and text; also the one-line notices of common licences.
KNOWN = (
    ("MIT", _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)


def canonical(text: Column, spellings=SPELLINGS) -> Column:
    """The canonical form of a whole text, '' where nothing is left."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, SEPARATORS, " ")
    for odd, kept in spellings:
        out = F.replace(out, F.lit(odd), F.lit(kept))
    return F.trim(out)


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """One row for each canonical form; the list is a parameter of fixed size."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(known))
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, license, body)")
    return listed.groupBy(digest(F.col("body")).alias("l__digest")).agg(F.min_by("license", "i").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest of the canonical text, and the licence it is (or null)."""
    found = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    # the known list is a literal of a few rows
    return found.join(F.broadcast(known), F.col("digest") == F.col("l__digest"), "left").select("doc_id", "digest", "license")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(lower(coalesce(t, '')), {quoted(COPYRIGHT_LINE)}, chr(10), 'g'), {quoted(SEPARATORS)}, ' ', 'g')"
    for odd, kept in SPELLINGS:
        form = f"replace({form}, '{odd}', '{kept}')"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(KNOWN))
    return f"""WITH known AS (SELECT sha256(trim({form})) AS d, arg_min(license, i) AS license FROM (VALUES {rows}) AS v(i, license, t) GROUP BY 1),
docs AS (SELECT doc_id, CASE WHEN trim({form}) <> '' THEN sha256(trim({form})) END AS digest FROM (SELECT doc_id, text AS t FROM documents))
SELECT doc_id, digest, license FROM docs LEFT JOIN known ON digest = d"""
