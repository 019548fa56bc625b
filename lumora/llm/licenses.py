"""License scans with DataFrame functions only: sparse TF-IDF cosine to templates, then directory inheritance.

The passages of a text are its lines and its paragraphs (lines between blank ones), and of a licence file the whole text as
well. Terms are runs of a-z and 0-9 of the lower-cased text. A term's weight is tf * ln((N + 1) / (df + 1)); df counts, over
all texts, those that have the term. A passage's licence is that of the template with the largest cosine, if that is
THRESHOLD or more; a text's is that of its best passage. On a tie the template with more terms wins, then the first name.
A text that declares an SPDX identifier has that licence, as if by a cosine of 1.

No word list picks the passages. A passage whose shared terms with a template have less than THRESHOLD squared of the squared
length of the template can't reach THRESHOLD (Cauchy and Schwarz); so one that has none of the templates' heavy
terms - all but the lightest ones that make up less than that - is left out before its terms are counted. That loses nothing.

A text without a licence of its own inherits that of the nearest ancestor directory (its own first) with a licence
file that has one; of several such files in a directory the one with the least path counts.

Null and empty texts have no passages, and can only inherit; a null path has no directory and inherits nothing.
Every row is judged by itself, whether doc_ids repeat or are null. Further columns are ignored, and
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import cut, heavy, salted, spread, table

#: Names by which notices state licences.
NAMES = (
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache 2.0 License")),
    ("BSD-2-Clause", ("BSD 2-Clause License",)),
    ("BSD-3-Clause", ("BSD 3-Clause License",)),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3")),
    ("ISC", ("ISC License",)),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1",)),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3")),
    ("MIT", ("MIT License",)),
    ("MPL-2.0", ("Mozilla Public License, version 2.0",)),
)
_STATED = ("This work is licensed under the {}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "{}")
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: File headers and licence texts, beside what NAMES give.
TEXTS = (
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_END}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_3),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", _ISC),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MPL-2.0", _MPL),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TEMPLATES = tuple((name, form.format(x)) for name, stated in NAMES for x in stated for form in _STATED) + TEXTS
SPDX = "SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)"
THRESHOLD = 0.7
LICENSE_NAME = "(?i)^(un)?licen[sc]e|^copying|^notice"
DIGITS = 6


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _templates(spark: SparkSession) -> DataFrame:
    """(template, license, term, tf): as many rows as the constants above give."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    rows = spark.sql(f"SELECT col1 AS template, col2 AS license, col3 AS text FROM VALUES {values}")
    return rows.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files: doc_id, path, text, is_file (a licence file, null: by the path's last part). One row a file: doc_id, path, license, cosine, inherited_from."""
    spark = files.sparkSession
    own = F.coalesce(F.col("is_file"), F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME), F.lit(False))
    files = files.select("doc_id", "path", "text", own.alias("is_file"))
    # over all texts: a common term is a row a task before the shuffle
    df = cut(files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n = F.broadcast(files.agg(F.count("*").alias("n")))  # one row
    idf = lambda f: F.log((F.col("n") + 1) / (F.coalesce(f, F.lit(0)) + 1))
    templates = _templates(spark)
    known = df.join(F.broadcast(templates.select("term").distinct()), "term", "left_semi")
    words = cut(templates.join(F.broadcast(known), "term", "left").crossJoin(n).select("template", "license", "term", (F.col("tf") * idf(F.col("df"))).alias("w")))
    norm = words.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("terms"))
    # terms without which no template can be reached
    up = Window.partitionBy("template").orderBy(F.col("w"), "term")
    light = words.withColumn("part", F.sum(F.col("w") * F.col("w")).over(up) / F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    needed = F.broadcast(light.where(F.col("part").isNull() | (F.col("part") >= (threshold - 2 * 10**-DIGITS) ** 2)).agg(F.collect_set("term").alias("needed")))  # one row
    passages = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n"), F.when(F.col("is_file"), F.array("text")).otherwise(F.array().cast("array<string>"))))
    able = lambda t: F.arrays_overlap(_terms(t), F.col("needed"))
    kept = F.when(able(F.col("text")), F.filter(passages, able))
    tag = F.nullif(F.regexp_extract("text", SPDX, 1), F.lit(""))
    seen = files.crossJoin(needed).select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "is_file", tag.alias("tag"), F.coalesce(kept, F.array().cast("array<string>")).alias("passages"))
    seen = cut(seen)
    # each distinct passage once, however many texts have it
    units = seen.select(F.explode("passages").alias("passage")).distinct().select(F.md5("passage").alias("unit"), _terms(F.col("passage")).alias("words"))
    tf = cut(units.select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf")))
    hot = heavy(tf, "term")
    weighed = salted(tf, hot, "unit", "term").join(spread(df, hot, "term"), ["term", "salt__"], "left").crossJoin(n).select("unit", "term", (F.col("tf") * idf(F.col("df"))).alias("w"))
    length = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(F.broadcast(words.withColumnRenamed("w", "t")), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(length, "unit").join(F.broadcast(norm), "template").withColumn("cosine", F.round(F.try_divide("dot", F.col("length") * F.col("norm")), DIGITS))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("terms")).alias("terms"), "license")).alias("b")
    best = cut(scored.where(F.col("cosine") >= threshold).groupBy("unit").agg(best))
    held = seen.where("tag is null").select("row", F.explode("passages").alias("passage")).select("row", F.md5("passage").alias("unit"))
    hot = heavy(cut(held.join(best.select("unit"), "unit", "left_semi")), "unit")
    found = salted(held, hot, "row", "unit").join(spread(best, hot, "unit"), ["unit", "salt__"]).groupBy("row").agg(F.min("b").alias("b"))
    files = seen.select("row", "doc_id", "path", "is_file", "tag", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")).join(found, "row", "left")
    files = cut(files.select("doc_id", "path", "is_file", "directory", F.coalesce("tag", "b.license").alias("license"), F.when(F.col("tag").isNotNull(), 1.0).otherwise(-F.col("b.c")).alias("cosine")))
    # a directory's own licence, then the nearest above by joining every directory's ancestors
    given = files.where("is_file and license is not null and path is not null").groupBy("directory").agg(F.min(F.struct("path", "license")).alias("g"))
    above = files.where("path is not null").select("directory").distinct().withColumn("parts", F.split("directory", "/"))
    above = above.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", 1, i), "/").alias("ancestor")))).alias("a")).select("directory", "a.*")
    near = above.join(given.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max(F.struct("depth", F.col("g.license").alias("license"), F.col("g.path").alias("path"))).alias("near"))
    hot = heavy(files, "directory")
    out = salted(files, hot, "path", "directory").join(spread(near, hot, "directory"), ["directory", "salt__"], "left")
    mine = F.col("license").isNotNull()
    free = F.col("path").isNotNull() & ~mine
    return out.select(
        "doc_id", "path", F.when(mine, F.col("license")).when(free, F.col("near.license")).alias("license"), "cosine", F.when(free, F.col("near.path")).alias("inherited_from")
    )


#: Documents have no paths: this gives each one by its source, language and id, some of them higher up; every tenth is a licence file.
_PATH = """concat_ws('/', '', coalesce(source, 'none'), CASE WHEN doc_id % 1000 = 0 THEN NULL ELSE coalesce(lang, 'none') END,
  CASE WHEN doc_id % 50 = 0 THEN NULL ELSE concat('d', CAST(floor(doc_id / 64) AS BIGINT)) END, CASE WHEN doc_id % 10 = 0 THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END)"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at paths made of their source, language and id; licence files give theirs to what lies below their directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), "text", F.lit(None).cast("boolean").alias("is_file"))
    return scan(docs)


_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_VALUES}) v(template, license, body)),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
f AS (SELECT doc_id, text, doc_id % 10 = 0 AS is_file, nullif(regexp_extract(text, '{SPDX.replace(chr(92) * 2, chr(92))}', 1), '') AS tag, {_PATH} AS path FROM documents),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM f) GROUP BY term),
tw AS (SELECT template, license, term, tf * ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM tt LEFT JOIN df USING (term), n),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm, count(*) AS terms FROM tw GROUP BY template),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), CASE WHEN is_file THEN [text] ELSE [] END)) AS passage FROM f WHERE tag IS NULL),
p AS (SELECT DISTINCT passage FROM u),
uw AS (SELECT passage, term, count(*) * any_value(ln((n + 1) / (df + 1))) AS w FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM p) JOIN df USING (term), n GROUP BY passage, term),
un AS (SELECT passage, sqrt(sum(w * w)) AS length FROM uw GROUP BY ALL),
s AS (SELECT passage, license, terms, round(dot / (length * norm), {DIGITS}) AS cosine FROM (SELECT passage, template, license, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (term) GROUP BY ALL) JOIN un USING (passage) JOIN tn USING (template) WHERE length > 0),
b AS (SELECT doc_id, cosine, license FROM s JOIN u USING (passage) WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, terms DESC, license) = 1),
g AS (SELECT doc_id, path, is_file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, CASE WHEN tag IS NOT NULL THEN 1.0 ELSE cosine END AS cosine, coalesce(tag, license) AS license FROM f LEFT JOIN b USING (doc_id)),
given AS (SELECT directory, path, license FROM g WHERE license IS NOT NULL AND is_file QUALIFY row_number() OVER (PARTITION BY directory ORDER BY path) = 1),
near AS (SELECT a.directory, given.path, given.license FROM (SELECT DISTINCT directory FROM g) a JOIN given ON a.directory = given.directory OR starts_with(a.directory, given.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY a.directory ORDER BY length(given.directory) DESC) = 1)
SELECT doc_id, g.path, coalesce(g.license, near.license) AS license, cosine, CASE WHEN g.license IS NULL THEN near.path END AS inherited_from FROM g LEFT JOIN near USING (directory)
"""

QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE = {"op3_license_scan": _SQL}
