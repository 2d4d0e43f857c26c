"""License scans: lines, whole texts and word windows against license texts, by Dice over word bigrams.

A text is normalised to its words (A-Z lower-cased, parted by anything else in ASCII) and seen
as the set of its word pairs.  Dice of two sets of sizes n and m is at most
2 min(n, m) / (n + m), so a notice of m pairs needs n between m t / (2 - t) and m (2 - t) / t.
Each notice is listed under every size it admits, and a unit meets only the notices listed
under its own size: an equi-join, not a comparison with all.

A notice inside a longer text, wrapped over lines or amid other words, is found by windows of the
notice's own number of words, whatever the line ends.  Their size bound prunes twice: a window
that reaches t shares at least m t / (2 - t) pairs with the notice, so a text without one of the
notice's m - m t / (2 - t) + 1 rarest pairs (those of the longest words) holds no such window, and
only a text with enough of its pairs is walked.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import let, letter_words, table

LIMIT = 0.8
#: fixed values: public license notices
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-full-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS '
        'IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered "
        "from any source distribution."
    ),
    "GPL-3.0-full-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSL-1.0-header": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
}


def _starts(words: Column) -> Column:
    """Positions at which a word pair begins."""
    return F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))


def _all_pairs(words: Column) -> Column:
    """Hashes of neighbouring words, by position."""
    return F.transform(_starts(words), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def _pairs(words: Column) -> Column:
    """Distinct hashes of neighbouring words."""
    return F.array_distinct(_all_pairs(words))


def _notice_rows(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in notices.items()]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def notice_index(spark: SparkSession, notices: dict[str, str], limit: float) -> DataFrame:
    """n (admitted size), license, m, wanted (pairs); its rows depend on the notices only."""
    rows = _notice_rows(spark, notices)
    rows = rows.select("license", let(letter_words(F.col("notice")), _pairs).alias("wanted"))
    rows = rows.withColumn("m", F.size("wanted")).where("m > 0")
    low = F.ceil(F.col("m") * (limit / (2 - limit)) - 1e-9)
    high = F.floor(F.col("m") * ((2 - limit) / limit) + 1e-9)
    return rows.select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("n"), "license", "m", "wanted")


def window_notices(spark: SparkSession, notices: dict[str, str], limit: float) -> list[Row]:
    """license, size (words), m, need (least shared pairs), wanted (pairs), rare (pairs of which a match has one)."""

    def ranked(words: Column) -> Column:
        letters = lambda i: F.length(F.get(words, i)) + F.length(F.get(words, i + 1))
        pair = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))
        found = F.transform(_starts(words), lambda i: F.struct((-letters(i)).alias("rank"), pair(i).alias("pair")))
        return F.struct(F.size(words).alias("size"), F.sort_array(F.array_distinct(found))["pair"].alias("wanted"))

    rows = _notice_rows(spark, notices).select("license", let(letter_words(F.col("notice")), ranked).alias("r"))
    rows = rows.select("license", "r.size", F.size("r.wanted").alias("m"), "r.wanted").where("m > 0")
    need = F.ceil(F.col("m") * (limit / (2 - limit)) - 1e-9).cast("int")
    rows = rows.withColumn("need", need)
    return rows.withColumn("rare", F.slice("wanted", F.lit(1), F.col("m") - F.col("need") + 1)).collect()


def spans(docs: DataFrame, notices: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """doc_id, license, dice, first_word, n_words of the parts of whole texts that reach the limit.

    For each notice, windows of its number of words (the last ones are cut by the text's end) start
    at every word that begins one of its pairs; those that reach the limit and overlap are one span
    with their best Dice.  Line ends count as blanks, words are numbered from 0.  Null and empty
    texts and texts of one word have no span.  Null doc_ids and repeated rows are scanned like
    others; other columns are ignored; notices of one word match nothing.
    """
    rows = window_notices(docs.sparkSession, notices or NOTICES, limit)  # one row per notice
    text = F.col("text").cast("string")
    none = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not rows:
        empty = "CAST(NULL AS STRING) license, CAST(NULL AS DOUBLE) dice, 0 first_word, 0 n_words"
        return none.where("false").selectExpr("doc_id", *empty.split(", "))
    rare = F.lit(sorted({pair for r in rows for pair in r.rare}))
    listed = F.array(*[
        F.struct(
            F.lit(r.license).alias("license"), F.lit(r["size"]).alias("size"), F.lit(r.m).alias("m"),
            F.lit(r.need).alias("need"), F.lit(list(r.wanted)).alias("wanted"),
        )
        for r in rows
    ])

    def candidate(words: Column) -> Column:
        unit = F.array(F.struct(F.size(words).alias("length"), _all_pairs(words).alias("pairs")))
        return F.filter(unit, lambda u: F.arrays_overlap(u["pairs"], rare))

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(let(letter_words(text), candidate)))
    enough = F.filter(listed, lambda n: F.size(F.array_intersect(F.col("pairs"), n["wanted"])) >= n["need"])
    found = found.select("doc_id", "length", "pairs", F.inline(enough))

    def window(i: Column) -> Column:
        part = F.array_distinct(F.slice("pairs", i + 1, F.col("size") - 1))
        dice = lambda p: 2 * F.size(F.array_intersect(p, F.col("wanted"))) / (F.size(p) + F.col("m"))
        return F.struct(i.alias("start"), let(part, dice).alias("dice"))

    def joined(hits: Column) -> Column:
        apart = lambda j: F.get(hits, j)["start"] >= F.get(hits, j - 1)["start"] + F.col("size")
        every = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))

        def span(heads: Column, j: Column, k: Column) -> Column:
            until = F.coalesce(F.get(heads, k + 1), F.size(hits))
            first = F.get(hits, j)["start"]
            end = F.least(F.get(hits, until - 1)["start"] + F.col("size"), F.col("length"))
            best = F.array_max(F.slice(hits, j + 1, until - j)["dice"])
            return F.struct(best.alias("dice"), first.alias("first_word"), (end - first).alias("n_words"))

        heads = F.filter(every, lambda j: (j == 0) | apart(j))
        return let(heads, lambda h: F.transform(h, lambda j, k: span(h, j, k)))

    every = F.sequence(F.lit(0), F.size("pairs") - 1)
    starts = F.filter(every, lambda i: F.array_contains("wanted", F.get("pairs", i)))
    hits = F.filter(F.transform(starts, window), lambda h: h["dice"] >= limit)
    return found.select("doc_id", "license", F.inline(let(hits, joined)))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """doc_id, unit (0: whole text, else line number), license, dice, n_words (of the unit) for all that reach the limit.

    Null and empty texts and texts of a single word match nothing.  Null doc_ids and repeated rows
    are scanned like others; notices that tie are all reported; other columns are ignored.
    """
    index = notice_index(docs.sparkSession, notices or NOTICES, limit)
    least = min((r.n for r in index.select("n").collect()), default=1)  # one row per notice and size
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    units = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.posexplode(F.concat(F.array(F.when(F.size(lines) > 1, text)), lines)).alias("unit", "part"),
    )

    def sized(words: Column) -> Column:
        pairs = F.when(F.size(words) > least, _pairs(words)).otherwise(F.array().cast("array<bigint>"))
        return let(pairs, lambda p: F.array(F.struct(F.size(words).alias("n_words"), F.size(p).alias("n"), p.alias("pairs"))))

    units = units.where("part IS NOT NULL").select("doc_id", "unit", F.inline(let(letter_words(F.col("part")), sized)))
    met = units.join(F.broadcast(index), "n")  # a few dozen rows per notice
    dice = 2 * F.size(F.array_intersect("pairs", "wanted")) / (F.col("n") + F.col("m"))
    return met.select("doc_id", "unit", "license", dice.alias("dice"), "n_words").where(F.col("dice") >= limit)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts (unit 0), lines (their number) and spans of whole texts across lines (unit -1), words numbered in their unit."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs).withColumn("first_word", F.lit(0)).unionByName(spans(docs).withColumn("unit", F.lit(-1)))
    return found.withColumn("dice", F.round("dice", 6))


def _sql() -> str:
    words = (
        "regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    notices = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())
    return f"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
parts AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS t FROM lines
  UNION ALL SELECT doc_id, 0, text FROM lines WHERE len(l) > 1),
u AS (SELECT doc_id, unit, len(w) AS n_words, {pairs} AS p FROM (SELECT doc_id, unit, {words} AS w FROM parts)),
n AS (SELECT license, {pairs} AS q FROM (SELECT license, {words} AS w FROM (VALUES {notices}) v(license, t))),
d AS (
  SELECT doc_id, unit, n_words, license, 2 * len(list_intersect(p, q)) / (len(p) + len(q)) AS dice
  FROM u, n WHERE len(p) > 0 AND 2 * least(len(p), len(q)) / (len(p) + len(q)) >= {LIMIT} - 1e-9),
sized AS (SELECT license, len(w) AS size, {pairs} AS q FROM (SELECT license, {words} AS w FROM (VALUES {notices}) v(license, t))),
texts AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
placed AS (SELECT row, doc_id, len(w) AS total, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS p FROM texts),
walked AS (
  SELECT row, doc_id, total, p, license, size, q, unnest(range(0, len(p))) AS start FROM placed, sized
  WHERE len(list_intersect(list_distinct(p), q)) >= {LIMIT} / (2 - {LIMIT}) * len(q) - 1e-9),
windows AS (
  SELECT row, doc_id, total, license, size, q, start, list_distinct(p[start + 1 : start + size - 1]) AS part
  FROM walked WHERE list_contains(q, p[start + 1])),
close AS (
  SELECT *, 2 * len(list_intersect(part, q)) / (len(part) + len(q)) AS dice FROM windows),
parted AS (
  SELECT *, CASE WHEN start < lag(start) OVER same + size THEN 0 ELSE 1 END AS head FROM close WHERE dice >= {LIMIT}
  WINDOW same AS (PARTITION BY row, license ORDER BY start)),
grouped AS (SELECT *, sum(head) OVER (PARTITION BY row, license ORDER BY start) AS part_no FROM parted)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, round(dice, 6) AS dice,
  0 AS first_word, CAST(n_words AS INTEGER) AS n_words FROM d WHERE dice >= {LIMIT}
UNION ALL SELECT any_value(doc_id), -1, license, round(max(dice), 6), CAST(min(start) AS INTEGER),
  CAST(least(max(start) + any_value(size), any_value(total)) - min(start) AS INTEGER) FROM grouped GROUP BY row, license, part_no"""


OP4_SQL = _sql()
