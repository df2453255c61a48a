"""Licence scan by canonical digests: texts are normalised, hashed and hash-joined to known digests.

Normalisation works on the whole text: lower case; copyright notices go (the word or sign followed by a sign, "(c)" or a
year, to the end of that clause: a full stop and white space that is no abbreviation's, a line's end, one of ``OPENINGS``, or ``NOTICE_CHARS``
characters); every run of other characters than letters and digits becomes one space; equivalent spellings become one;
"all rights reserved" and a title before the text ("MIT License") go. Line breaks make no difference but as the end of a notice: where a
notice itself is wrapped, its second line stays. The whole document is looked up as one text, and every line as one (one-line notices).
The known texts go through the same expressions. Native expressions only.

The known table is the one broadcast side: it has one row per known text, a list in this module or
given by the caller and checked against ``MOST_KNOWN``; beyond that the join is left to the planner.

Defined results: null or empty text has the digest of the empty canonical text and no licence. Very long texts are read whole, by
linear expressions. Repeated rows are answered row by row; further columns are ignored. A text known under two names gets the lesser one.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import quoted

MOST_KNOWN = 10_000

# Equivalent spellings of licence texts (fixed values): the first becomes the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"))

# Known texts (fixed values): one-line notices, and short licences in full; below, the whole texts in ``licenses``.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", '''MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'''),
    ("ISC", '''ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.'''),
)


def unwrapped(text: str) -> str:
    """``text`` with every paragraph on one line."""
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t\f]*\n", text.replace("\r", "")))


_FOLDER = Path(__file__).parent / "licenses"
_WHOLE = tuple(sorted((f.stem.split("@")[0], f.read_text(encoding="utf-8")) for f in _FOLDER.glob("*.txt")))
if not _WHOLE:
    raise FileNotFoundError(f"no licence texts in {_FOLDER}: the package was installed without its data files")
# a notice that is wrapped in its source ends elsewhere where the paragraph is one line
KNOWN += (*_WHOLE, *((i, unwrapped(t)) for i, t in _WHOLE))

OPENINGS = ("permission is hereby granted", "permission to use", "redistribution and use", "everyone is permitted",
            "this software is provided")  # of licence texts, where a notice before them has ended
OPENING = "(%s)" % "|".join(OPENINGS).replace(" ", "\\s+")  # also across a line break
ENDING = "all\\s+rights\\s+reserved\\.?"
NOTICE_CHARS = 300
_YEAR = "(?:19|20)[0-9]{2}"
_SHORT = "(?:[a-z]|inc|ltd|co|corp|jr|sr|dr|st)"  # words whose full stop ends no clause
NOTICE = (f"(?:copyright[ \\t]*(?:\\(c\\)|©|{_YEAR})|©|\\(c\\)[ \\t]*(?:copyright[ \\t]+)?{_YEAR})"
          f"(?:[ \\t]{_SHORT}\\.(?:[a-z]\\.)*|\\.[^\\s.]|[^\\n.]){{0,{NOTICE_CHARS}}}\\.?")
RESERVED = " *all rights reserved *"
TITLE = ("^(?:the )?(?:mit|expat|x11|isc|zlib|bsd(?: [0234] clause)?(?: new| revised| simplified)?)(?: original)? license"
         "(?: (?:mit|expat|x11|isc))? ")


def _spelt(words: Column) -> Column:
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(old), F.lit(new))
    return words


def with_canonical(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``lines`` (canonical lines that are not empty) and ``canonical`` (the whole text)."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")))
    opened = F.regexp_replace(F.regexp_replace("canonical", ENDING, ". "), OPENING, "\n$1")
    said = F.contains("canonical", F.lit("copyright")) | F.contains("canonical", F.lit("(c)")) | F.contains("canonical", F.lit("©"))
    done = df.withColumn("canonical", low)
    done = done.withColumn("canonical", F.when(said, F.regexp_replace(opened, NOTICE, " ")).otherwise(F.col("canonical")))
    done = done.withColumn("canonical", F.regexp_replace("canonical", "[^\\p{L}\\p{N}\\n]+", " "))

    def line(x: Column) -> Column:
        return F.when(x.contains("all rights reserved"), F.trim(F.regexp_replace(x, RESERVED, " "))).otherwise(F.trim(x))
    done = done.withColumn("lines", F.array_remove(F.transform(F.split(_spelt(F.col("canonical")), "\n"), line), ""))
    # phrases that a line break divides meet again
    whole = _spelt(F.regexp_replace(F.replace("canonical", F.lit("\n"), F.lit(" ")), "  +", " "))
    whole = F.trim(F.when(whole.contains("all rights reserved"), F.regexp_replace(whole, RESERVED, " ")).otherwise(whole))
    return done.withColumn("canonical", whole).withColumn("canonical", F.regexp_replace("canonical", TITLE, ""))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id), one row per canonical text."""
    rows = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known])).alias("k")).select("k.*")
    done = with_canonical(rows, F.col("text")).select(F.sha2("canonical", 256).alias("digest"), "license_id")
    return done.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", known=KNOWN) -> DataFrame:
    """(id, canonical_sha256, license_id, notices) of every row: the licence that the whole text is (or null), and
    the licences that single lines of it are, sorted, comma-joined ('' if none)."""
    rows = df.select(quoted(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), quoted(text).alias("text"))
    whole = with_canonical(rows, F.col("text")).select(
        "id", "row", F.sha2("canonical", 256).alias("digest"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("marks"))
    units = whole.select("id", "row", "digest", F.array_contains("marks", F.col("digest")).alias("single"),
                         F.explode(F.array_union(F.array(F.col("digest")), F.col("marks"))).alias("unit"))
    table = known_digests(df.sparkSession, known).withColumnRenamed("digest", "unit")
    found = units.join(F.broadcast(table) if len(known) <= MOST_KNOWN else table, "unit", "left")
    is_whole = F.col("unit") == F.col("digest")
    # the digests of a row meet again by its key: partial sums leave about one small row per document to shuffle
    return found.groupBy("row", "id", "digest").agg(
        F.max(F.when(is_whole, F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~is_whole | F.col("single"), F.col("license_id")))), ",")
        .alias("notices"),
    ).select(F.col("id").alias(id_col), F.col("digest").alias("canonical_sha256"), "license_id", "notices")


def duckdb_sql(known=KNOWN) -> str:
    """The same question for DuckDB over ``documents``."""
    def spelt(x: str) -> str:
        for old, new in SPELLINGS:
            x = f"replace({x}, '{old}', '{new}')"
        return x
    low = "lower(replace(coalesce(text, ''), chr(13), ''))"
    opened = f"regexp_replace(regexp_replace({low}, '{ENDING}', '. ', 'g'), '{OPENING}', chr(10) || '\\1', 'g')"
    words = (f"regexp_replace(CASE WHEN regexp_matches({low}, 'copyright|\\(c\\)|©') THEN regexp_replace({opened}, '{NOTICE}', ' ', 'g') "
             f"ELSE {low} END, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')")
    lines = (f"list_filter(list_transform(string_split({spelt('words')}, chr(10)), lambda x: trim(regexp_replace(x, '{RESERVED}', ' ', 'g'))), "
             "lambda x: x <> '')")
    whole = f"trim(regexp_replace({spelt(chr(34) + 'joined' + chr(34))}, '{RESERVED}', ' ', 'g'))"

    def canonical(rows: str, keep: str) -> str:
        return f"""SELECT {keep}, {lines} AS lines, sha256(regexp_replace({whole}, '{TITLE}', '')) AS digest
    FROM (SELECT *, regexp_replace(replace(words, chr(10), ' '), '  +', ' ', 'g') AS joined FROM (SELECT *, {words} AS words FROM {rows}))"""
    values = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in known)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM ({canonical(f"(VALUES {values}) AS t(license_id, text)", "license_id")}) GROUP BY 1),
     docs AS MATERIALIZED ({canonical("(SELECT row_number() OVER () AS r, doc_id, text FROM documents)", "r, doc_id")}),
     units AS (SELECT DISTINCT r, sha256(line) AS digest FROM (SELECT r, unnest(lines) AS line FROM docs)),
     notes AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
               FROM units JOIN known USING (digest) GROUP BY r)
SELECT w.doc_id, w.digest AS canonical_sha256, k.license_id, coalesce(n.notices, '') AS notices
FROM docs w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notes n ON n.r = w.r
"""
