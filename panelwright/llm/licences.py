"""Licence scans: canonical digests of entire texts, looked up among known licences. SQL expressions only.

Two copies of a licence that differ in case, punctuation, spacing, line breaks, copyright lines or equivalent
spellings have the same canonical text, and so the same SHA-256 digest.  A whole text is looked up by the digest of its
core, the canonical text without titles, statements of copyright in any form, owners' names and addresses, among the cores of
known licences (``licence_table``), which are computed by the same expressions.  The registered SQL knows the eight texts of
``KNOWN`` only, and no cores.  A statement of copyright that runs over several lines is not taken off whole.  Besides, every line that is in itself a known notice is counted, so that a document under a notice is found too.

Null text counts as empty; an empty canonical text is no licence.  Rows that repeat, and null doc_ids, get a row each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import licence_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public licence texts and notices, and spellings that licence guidelines call equivalent.
KNOWN = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License.",
    "MIT": 'MIT License\nCopyright (c) <year> <copyright holders>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authoris", "authoriz"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("honour", "honor"),
    ("initialis", "initializ"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognis", "recogniz"),
    ("sub license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
]
#: A line that states a copyright ("copyright (c) 2020 ...", "© ...", "all rights reserved"), after comment marks.
COPYRIGHT_LINE = r"(^|\n)[ \t\r#/*;<!-]*(copyright[ \t]*(\(c\)|©|[0-9]|<|by |:)|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)[^\n]*"
#: Everything but letters, digits, non-ASCII letters and line breaks.
SEPARATORS = r"[\x00-\x09\x0B-/:-@\[-`{-\x7F\x{00A0}-\x{00BF}\x{2010}-\x{2027}\x{2030}-\x{205E}]+"


#: In canonical lines, a statement of copyright in any other form ("copyright jane doe", "copyright yyyy name of owner"), or of the
#: licence's short name; a wrapped line of a licence that goes on with "copyright notice", "copyright law" ... is none.
COPYRIGHT_STATEMENT = (
    r"(^|\n) ?((portions )?copyrights? (?!(notices?|holders?|owners?|ownership|licen[sc]es?|laws?|interests?|and|or|on|of|in|is|as|to|are|also|like|if|for|those|permissions?"
    r"|treat(y|ies)|doctrines?|line|disclaimers?|resulting|statements?|patents?|trademarks?|the (software|library|program|work))\b)[^ \n]|spdx (license identifier|filecopyrighttext) )[^\n]*"
)
_TITLES = (
    r"license mit|license|mit license( mit)?|expat license|mit expat license|mit no attribution( license)?|mit 0 license|isc license( isc)?|zlib license|zlib libpng license"
    r"|bsd license|(new|modified|revised|simplified|freebsd|original) bsd license|bsd [0234] clause( (new or revised|simplified|original or old))? license|[0234] clause bsd license|bsd zero clause license|0bsd"
    r"|apache (software )?license( version 2 0( january 2004)?)?|http www apache org licenses( license 2 0)?|mozilla public license( version)? [12] [01]"
    r"|gnu (lesser |library |affero )?general public license|gnu free documentation license|version [123]( [0-9])?( [0-9]{1,2})? (january|february|march|june|november) [0-9]{4}"
    r"|boost software license version 1 0( august 17th 2003)?|unlicense|creative commons( legal code)?|cc0 1 0 universal|artistic license"
)
#: In one line, what is taken as the same: the address of a foundation, titles at the start, owners named in the terms.
SAME = [
    (r"(51 franklin st(reet)?|59 temple pl(ace)?|31 milk st(reet)?|675 mass(achusetts)? ave(nue)?)( [a-z0-9]+){1,8}? usa( |$)", ""),
    (rf"^((the )?({_TITLES}) )+", ""),
    (r"neither the names? of .{1,120}? nor the names of (its |his |her |their |any )?contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this product includes software developed by .{1,120}? neither", "this product includes software developed by the organization neither"),
    (r"this software is provided by .{1,120}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall .{1,120}? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
]
#: The start of a line that names a licence.
NOTICE = r"^(((this|the) [a-z]+ is )?(licensed|released|distributed|made available) under (the terms of )?(the |an? )?|spdx license identifier )"
#: Every known text has one of these in its canonical form.
MARKS = ("licen", "permi", "express or implied")


def canonical_lines(text: Column) -> Column:
    """The text with everything normalised but its line breaks."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, SEPARATORS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def core(lines: Column) -> Column:
    """Canonical lines without what differs between copies of one licence: statements of copyright, titles, owners, addresses."""
    out = squeezed(F.regexp_replace(lines, COPYRIGHT_STATEMENT, "$1"))
    for old, new in SPELLINGS:
        if " " in old:  # across a line break
            out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, instead in SAME:
        out = F.regexp_replace(out, pattern, instead)
    return out


def line_digest(line: Column) -> Column:
    return digest(F.regexp_replace(line, NOTICE, "licensed under "))


def known_entries(spark: SparkSession, known: list[tuple[str, str]]) -> list[Row]:
    """(license, text, line_digest, core_digest) of the canonical texts among those given; no more than texts were given."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(set(known))])
    given = spark.range(1).select(F.explode(rows.cast("array<struct<license: string, text: string>>")).alias("given")).select("given.*")
    lines = given.select("license", canonical_lines(F.col("text")).alias("lines")).select("license", squeezed(F.col("lines")).alias("text"), core(F.col("lines")).alias("core"))
    return lines.where("text <> ''").select("license", "text", line_digest(F.col("text")).alias("line_digest"), F.when(F.col("core") != "", digest(F.col("core"))).alias("core_digest")).collect()


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    """The least license of the digest, or null."""
    table: dict[str, str] = {}
    for k, v in pairs:
        table[k] = min(v, table.get(k, v))
    # one constant, however many texts there are
    return F.try_element_at(F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in sorted(table.items()))), F.lit("\x01"), F.lit("\x02")), key) if table else F.lit(None).cast("string")


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, license of the entire text, and notices: the licences whose text is a whole line."""
    given = [*KNOWN.items(), *licence_table.texts(), *licence_table.notices()] if known is None else list(known.items())
    entries = known_entries(docs.sparkSession, given)
    # a text or line without any of the marks equals no known text
    marks = MARKS if all(any(m in r.text for m in MARKS) for r in entries) else ("",)
    marked = lambda x: reduce(or_, [F.contains(x, F.lit(m)) for m in marks])
    whole = _lookup([(r.core_digest, r.license) for r in entries if r.core_digest], digest(core(F.col("lines"))))
    rows = docs.select(F.col("doc_id").cast("long"), canonical_lines(F.col("text").cast("string")).alias("lines"))
    rows = rows.withColumn("line", F.filter(F.split("lines", "\n"), lambda x: (F.length(x) > 1) & marked(x)))
    found = F.transform(F.col("line"), lambda x: _lookup([(r.line_digest, r.license) for r in entries], line_digest(squeezed(x))))
    return rows.select(
        "doc_id", digest(squeezed(F.col("lines"))).alias("digest"), F.when(marked(F.col("lines")), whole).alias("license"),
        F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("notices"),
    ).select("doc_id", "digest", "license", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ", ").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, {_quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
    out = f"regexp_replace({out}, {_quoted(SEPARATORS)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def squeezed_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


def scan_sql(known: dict[str, str] = KNOWN) -> str:
    """The same result in SQL, with lines in rows of their own."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known.items())
    return f"""
WITH known AS (
  SELECT license, sha256({squeezed_sql(canonical_sql("text"))}) AS digest FROM (VALUES {values}) AS given(license, text)
), canonical AS (
  SELECT doc_id, {canonical_sql("text")} AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM canonical
), notice AS (
  SELECT doc_id, count(DISTINCT license) AS n_notices, string_agg(DISTINCT license, ', ' ORDER BY license) AS notices
  FROM line JOIN known ON sha256({squeezed_sql("line")}) = digest GROUP BY doc_id
)
SELECT c.doc_id, sha256({squeezed_sql("lines")}) AS digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM canonical c LEFT JOIN known k ON k.digest = sha256({squeezed_sql("lines")}) LEFT JOIN notice n ON n.doc_id = c.doc_id
"""
