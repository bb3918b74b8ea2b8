"""License scan by canonical digest lookup, with DataFrame functions only.

Method. A text is brought into canonical form: lower case; lines that only state a copyright are
dropped; equivalent spellings become one; every run of characters other than letters and digits
becomes one space. The SHA-256 digest of the whole canonical text is hash-joined to the digests of
known license texts and notices, canonicalised by the same expressions. Entire texts are compared:
the document as a whole, every line, and every paragraph of several lines (between blank ones) as a
text of its own, as notices stand in a document.

Scale. One pass; lines and paragraphs are rows of a digest and the place they came from. The known
texts are broadcast up to `KNOWN_ROWS` of them, and joined by a shuffle beyond. Only matched parts are
grouped back to their documents.

Edge cases: null and empty texts, and texts that canonicalise to nothing, match nothing. Rows with
equal doc_id and text are rows of their own. Of known texts with one canonical form the first name
counts. A very long text is cut into its lines whole. A null doc_id is carried; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

KNOWN_ROWS = 10_000

#: Public license notices and short licenses, by SPDX identifier.
LICENSES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Equivalent spellings, applied in order to lower-case text.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("share-alike", "sharealike"),
    ("no-derivatives", "noderivatives"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https://", "http://"),
    ("copyright owner", "copyright holder"),
    ("creative commons attribution", "cc by"),
]
#: A line that states a copyright, or that all rights are reserved. A wrapped license may begin a line with "copyright notice" or "copyright holders".
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright(?![^\p{L}\p{N}]*(?:notice|holder|owner)s?(?![\p{L}\p{N}]))|\(c\)|©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\n]*$"
#: The same in the SQL, which has no lookahead: there every line that begins with the word goes.
SQL_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: What parts paragraphs: a line end and a blank line.
PARAGRAPH = r"\n[ \t\r]*\n"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    # a spelling of several words may lie across a line break
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def known(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts; the first name of equal texts counts."""
    licenses = LICENSES if licenses is None else licenses
    rows = spark.createDataFrame(licenses, "license string, text string")
    return rows.select(F.unhex(F.sha2(canonical(F.col("text")), 256)).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, digest (of the whole text), license (of the whole text), notices (sorted names of the matches of lines and paragraphs), n_notices."""
    spark = docs.sparkSession
    table = known(spark, licenses)
    table = F.broadcast(table) if len(LICENSES if licenses is None else licenses) <= KNOWN_ROWS else table
    name = lambda x: F.unhex(F.sha2(x, 256))
    whole = F.coalesce(F.col(text), F.lit(""))
    # a line is a part, and so is a paragraph of several lines; a text of one paragraph is looked up as a whole
    paragraphs = F.filter(F.split(whole, PARAGRAPH), lambda x: x.contains("\n"))
    paragraphs = F.when(whole.rlike(PARAGRAPH), paragraphs).otherwise(F.array().cast("array<string>"))
    lines = F.transform(F.concat(F.split(whole, "\n"), paragraphs), lambda x: name(canonical(x)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), name(F.coalesce(canonical(F.col(text)), F.lit(""))).alias("digest"), lines.alias("lines"))
    rows = written(rows, "digests")
    named = rows.select("row", F.explode("lines").alias("digest")).join(table, "digest")
    notices = named.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n_notices"))
    out = rows.select("doc_id", "row", "digest").join(table, "digest", "left").join(notices, "row", "left")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{SQL_COPYRIGHT_LINE}', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'))"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in LICENSES)
OP2_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(l) AS license FROM (VALUES {_VALUES}) v(l, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, sha256({_sql_canonical("text")}) AS digest FROM d),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM (SELECT r, sha256({_sql_canonical("x")}) AS digest FROM (SELECT r, unnest(list_concat(string_split(text, chr(10)), CASE WHEN regexp_matches(text, '{PARAGRAPH}') THEN list_filter(regexp_split_to_array(text, '{PARAGRAPH}'), lambda p: contains(p, chr(10))) ELSE [] END)) AS x FROM d)) JOIN k USING (digest) GROUP BY r)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notices FROM w LEFT JOIN k USING (digest) LEFT JOIN n USING (r)
"""
