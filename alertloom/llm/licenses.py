"""License scans: canonical texts looked up by digest.

A text is put in canonical form (case, punctuation, copyright lines, equivalent spellings); the sha256 of the whole form,
and of each of its lines, is hash-joined to the digests of known license texts and notices.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import let

# Public license texts and notices, and spellings that count as equal.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _long_texts() -> list[tuple[str, str]]:
    """The texts in `license_texts`, whole and up to the end of their terms."""
    found = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        found += [(path.stem, terms + end)] if end else []
    return found


KNOWN = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n" + _ISC_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    *((name, title + body) for name, body, titles in (
        ("BSD-2-Clause", _BSD_2 + _BSD_END, ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n")),
        ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END, ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n")),
    ) for title in titles),
    *_long_texts(),
)
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("per cent", "percent"), ("https", "http"),
    ("fulfil", "fulfill"), ("while", "whilst"), ("copyright owner", "copyright holder"),
)

#: A copyright line names a year, the sign or (c), a place to fill in, or a holder. (c) alone may also number a clause.
NOTICE = (
    r"(?i)^[^\p{L}\p{N}©(]*(?:copyright\b[^\p{L}\p{N}©(]*(?:\(c\)|©|\d{4}|[\[<{]|by\b)|©|\(c\)\s*(?:[\[<{]|\d{4}|copyright\b(?!\s+(?:notice|holder|owner|licen[cs]e))))"
    r"|^[^\p{L}\p{N}]*copyright\s+(?!(?:notices?|holders?|owners?|owner?ship|licen[cs]es?|laws?|statements?|interests?|rights?|treaty|protection|infringement|claims?|disclaimers?|terms?"
    r"|permission|and|or|in|is|are|of|to|for|as|on|under|with|shall|may)\b)(?-i:\p{Lu})"
)
#: After a line that ends so, the next goes on with its sentence.
RUNS_ON = r"(?i)(?:,|\b(?:the|of|or|and|a|an|any|above|is|are|this|that|all|by|under|to|in|for|with|no|such|following|retain|reproduce|its|their|each|applicable|other|including))\s*$"

#: Known digests (about 100 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without blank and copyright lines."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    marked = F.replace(F.replace(F.lower(raw), F.lit("©"), F.lit(" copyright ")), F.lit("(c)"), F.lit(" copyright "))
    plain = F.regexp_replace(marked, "[^\\p{L}\\p{N}\\n]+", " ")
    spaced = F.concat(F.lit(" "), F.replace(plain, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {a} "), F.lit(f" {b} "))
    trimmed = F.transform(F.split(spaced, "\n"), lambda line: F.btrim(line))
    both = F.struct(F.split(raw, "\n").alias("raw"), trimmed.alias("plain"))
    notice = lambda x, i: F.get(x["raw"], i).rlike(NOTICE) & ~F.coalesce(F.get(x["raw"], i - 1), F.lit("")).rlike(RUNS_ON)
    kept = lambda x: F.transform(x["plain"], lambda line, i: F.when(line.startswith("copyright "), F.when(notice(x, i), F.lit("")).otherwise(line)).otherwise(line))
    return F.filter(let(both, kept), lambda line: (line != "") & ~line.startswith("all rights reserved"))


def digests(text: Column) -> Column:
    """Array of (unit, digest): unit 0 is the whole text, others its lines in order."""
    line_digest = lambda line, i: F.struct((i + 1).alias("unit"), F.sha2(line, 256).alias("digest"))
    return let(canonical_lines(text), lambda lines: F.concat(F.array(F.struct(F.lit(0).alias("unit"), F.sha2(F.array_join(lines, " "), 256).alias("digest"))), F.transform(lines, line_digest)))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): the whole-text digest of every known text."""
    texts = spark.createDataFrame(list(known), "license string, text string")
    return texts.select(F.element_at(digests(F.col("text")), 1)["digest"].alias("digest"), "license").distinct()


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `text_digest`, `license` of the whole text, `n_notices`, `notices`.

    `license` is set when the entire text is a known one (the first by name if several are); `notices` joins the names
    of lines that are known texts, `n_notices` counts those lines. A null or empty text matches nothing. Digests
    are joined where they are made: known ones are counted and broadcast up to a limit, beyond it digests are shuffled.
    Rows equal in id and canonical text give equal rows. Other columns are not read.
    """
    units = docs.select(F.col(id_col).alias("id"), F.explode(F.array(digests(F.col(text_col)))).alias("all"))
    units = units.select("id", F.element_at("all", 1)["digest"].alias("text_digest"), F.explode("all").alias("u"))
    names = licenses.groupBy("digest").agg(F.min("license").alias("license"))
    names = F.broadcast(names) if licenses.count() <= BROADCAST_DIGESTS else names
    met = units.select("id", "text_digest", F.col("u.unit").alias("unit"), F.col("u.digest").alias("digest")).join(names, "digest", "left")
    hits = met.where("unit = 0 OR license IS NOT NULL")
    whole, line = F.col("unit") == 0, F.col("unit") > 0
    out = hits.groupBy("id", "text_digest").agg(
        F.sum(whole.cast("int")).alias("rows"), F.min(F.when(whole, F.col("license"))).alias("license"),
        F.sum(line.cast("int")).alias("lines"), F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("notices"),
    )
    each = out.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"))
    return each.select(F.col("id").alias(id_col), "text_digest", "license", (F.col("lines") / F.col("rows")).cast("long").alias("n_notices"), "notices")
