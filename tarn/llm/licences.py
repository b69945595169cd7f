"""Licence scans by canonical digest: whole texts, and whole lines, against known licence texts.

A text's canonical form has one case, no copyright lines, one spelling of words that vary, and single blanks in place of
punctuation and white space. Its SHA-256 is joined with the digests of the known texts, brought to the same form by the
same expression. All of it is built-in column functions; the known texts are a short list, so their side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices, as published.
WHOLE = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("noncommercial", "non-commercial"), ("sub-licens", "sublicens"), ("non-infringement", "noninfringement"), ("favour", "favor"),
    ("copyright owner", "copyright holder"), ("http://", "https://"),
)
COPYRIGHT_LINE = r"^[ \t#*/;%>-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form; null as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT_LINE, "")
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known) -> DataFrame:
    """(digest, licence) of known texts; one row per digest, the first by name."""
    rows = spark.createDataFrame([(n, t) for n, t in known], "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, text_col: str = "text", whole=WHOLE, notices=NOTICES) -> DataFrame:
    """``docs`` with canonical_sha256, licence (of the entire text, else null) and notices (of entire lines: names in order, by commas).

    These replace columns of the same names. Null and empty texts have the digest of the empty string, no licence and empty notices.
    Every row is looked up by itself, so repeated rows and an empty table need no care; a licence's text wrapped or set
    otherwise, with other copyright lines, is the same text. Whole lines count as texts of their own, however long.
    """
    known = known_digests(docs.sparkSession, whole).withColumnsRenamed({"digest": "digest_", "licence": "licence_"})
    by_line = {r.digest: r.licence for r in known_digests(docs.sparkSession, notices).collect()}
    names = F.create_map(*[F.lit(x) for kv in sorted(by_line.items()) for x in kv]) if by_line else F.create_map().cast("map<string,string>")
    text = F.col(f"`{text_col}`")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: names[digest(x)]), lambda x: x.isNotNull())))
    rows = docs.withColumns({"sum_": digest(text), "notices": F.array_join(found, ",")})
    joined = rows.join(F.broadcast(known), rows["sum_"] == known["digest_"], "left")
    return joined.withColumns({"canonical_sha256": F.col("sum_"), "licence": F.col("licence_")}).drop("sum_", "digest_", "licence_")


def scan_sql(table: str = "documents", whole=WHOLE, notices=NOTICES) -> str:
    """The same scan in DuckDB SQL; the known texts are brought to the canonical form there as well."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower(x), '(?m){COPYRIGHT_LINE}', '', 'g')"
    for said, meant in SPELLINGS:
        form = f"replace({form}, {quoted(said)}, {quoted(meant)})"
    canon = lambda x: "sha256(trim(regexp_replace(" + form.replace("lower(x)", f"lower({x})") + r", '[^\p{L}\p{N}]+', ' ', 'g')))"
    table_of = lambda some: ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in some)
    return f"""WITH w AS (SELECT {canon('t')} AS digest, min(n) AS licence FROM (VALUES {table_of(whole)}) AS v(n, t) GROUP BY 1),
k AS (SELECT {canon('t')} AS digest, min(n) AS name FROM (VALUES {table_of(notices)}) AS v(n, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, string_agg(DISTINCT k.name, ',' ORDER BY k.name) AS notices FROM l JOIN k ON {canon('line')} = k.digest GROUP BY doc_id)
SELECT d.doc_id, {canon('d.text')} AS canonical_sha256, w.licence, coalesce(m.notices, '') AS notices
FROM d LEFT JOIN w ON {canon('d.text')} = w.digest LEFT JOIN m ON d.doc_id = m.doc_id"""
