"""Licence scans by canonical digest: texts are normalised, hashed whole, and joined to known digests.  Native throughout.

The canonical form: A-Z in lower case, typographic marks made plain, copyright lines (``COPYRIGHT``) gone, every run of
ASCII punctuation and white space one blank, equivalent spellings made one.  The SHA-256 of the whole
canonical text is looked up in a table of known licences; so is, for notices of one line, the digest of
each line.  ``canonical_sql`` gives the same form for another SQL engine.

Null texts count as empty.  Extra columns of the input are left out
but for the id, whose name is a parameter; repeated rows are rows of their own.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known licences up to which they are broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 10_000

# Typographic marks and what they are read as.
READ_AS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\u00a0": " ", "…": " ", "•": " ", "·": " "}
MARKS, PLAIN = "".join(READ_AS), "".join(READ_AS.values())

# Spellings read as one, after punctuation is gone; in this order.
EQUIVALENTS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)
#: Copyright lines: the word with a mark, a year, "by" or the reservation after it, the mark with a year, or the reservation alone.
#: A line that only begins with the word is text that wraps there.
COPYRIGHT = r"\n[ \t*#/;-]*(?:copyright(?:[^\n]*(?:\(c\)|©|[0-9]{4}|all rights reserved)|[ \t]+by[ \t])[^\n]*|\(c\)[ \t]*(?:copyright|©|[0-9]{4})[^\n]*|©[^\n]*|all rights reserved[.!]*[ \t\r]*(?m:$))"
GAPS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

# Texts of public licences and notices, by their usual identifiers.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
LICENSES = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    c = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS, "abcdefghijklmnopqrstuvwxyz" + PLAIN)
    c = F.regexp_replace(F.concat(F.lit("\n"), c), COPYRIGHT, "")
    c = F.regexp_replace(c, GAPS, " ")
    for a, b in EQUIVALENTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(c)


def canonical_sql(text: str) -> str:
    """The same form as an SQL expression (RE2 regular expressions, ``translate``)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"translate(coalesce({text}, ''), {quote('ABCDEFGHIJKLMNOPQRSTUVWXYZ' + MARKS)}, {quote('abcdefghijklmnopqrstuvwxyz' + PLAIN)})"
    c = f"regexp_replace(regexp_replace(chr(10) || {c}, {quote(COPYRIGHT)}, '', 'g'), {quote(GAPS)}, ' ', 'g')"
    for a, b in EQUIVALENTS:
        c = f"replace({c}, {quote(a)}, {quote(b)})"
    return f"trim({c})"


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(canonical(text), 256)


def stored_digests() -> list[tuple[str, str]]:
    """``(digest, license_id)`` of full texts, standard headers and SPDX lines, from ``known_licenses.tsv`` (id, digest, what it is)."""
    lines = pkgutil.get_data(__package__, "known_licenses.tsv").decode().splitlines()
    return [(found, license_id) for license_id, found, _ in (line.split("\t") for line in lines)]


def known_licenses(spark: SparkSession, rows: tuple[tuple[str, str], ...] = LICENSES, stored: bool = True) -> DataFrame:
    """``(digest, license_id)``, one row per digest: of the texts given, and the stored ones unless left out."""
    texts = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in rows))
    table = spark.range(1).select(F.inline(texts))
    table = table.select(digest(F.col("text")).alias("digest"), "license_id")
    if stored:
        more = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for d, i in stored_digests()))
        table = table.union(spark.range(1).select(F.inline(more)))
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, canonical_sha256, license_id, notices, n_notice_lines``: the licence that the whole text is, and those its lines are.

    While the known table is small, its digests are a constant map that lines are looked up in, so no
    text is moved; else lines are joined to it by their digests.
    """
    some = known.limit(BROADCAST_ROWS + 1).collect()  # bounded
    few = len(some) <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col), digest(F.col(text_col)).alias("canonical_sha256"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if few:
        pairs = F.create_map(*(F.lit(v) for r in some for v in (r["digest"], r["license_id"]))) if some else F.lit(None).cast("map<string,string>")
        found = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.try_element_at(pairs, digest(x))), lambda x: x.isNotNull())
        rows = rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
        rows = rows.select(id_col, "canonical_sha256", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").alias("n_notice_lines"))
    else:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        lines = rows.select("row", F.explode(F.split("text", "\n", -1)).alias("line")).select("row", digest(F.col("line")).alias("digest"))
        met = lines.join(known, "digest").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.count(F.lit(1)).cast("int").alias("n_notice_lines"))
        rows = rows.join(met, "row", "left").select(id_col, "canonical_sha256", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notice_lines", F.lit(0)).alias("n_notice_lines"))
    whole = known.select(F.col("digest").alias("canonical_sha256"), "license_id")
    rows = rows.join(F.broadcast(whole) if few else whole, "canonical_sha256", "left")
    return rows.select(id_col, "canonical_sha256", "license_id", "notices", "n_notice_lines")


def scan_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The built-in licences' scan as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    return f"""WITH known AS (SELECT sha256({canonical_sql("text")}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) v(license_id, text) GROUP BY 1),
rows_ AS (SELECT row_number() OVER () AS r, {id_col}, {text_col} AS text, {canonical_sql(text_col)} AS c FROM {table}),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM rows_),
met AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n FROM (SELECT r, {canonical_sql("line")} AS c FROM lines) JOIN known ON digest = sha256(c) GROUP BY r)
SELECT {id_col}, sha256(c) AS canonical_sha256, license_id, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS INTEGER) AS n_notice_lines
FROM rows_ LEFT JOIN known ON digest = sha256(c) LEFT JOIN met USING (r)"""
