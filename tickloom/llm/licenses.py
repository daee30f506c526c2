"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest
ancestor directory. DataFrame functions only.

Of a document that holds a licence word, three kinds of units are compared with every template: lines with such a word,
blocks (neighbouring lines without an empty one between, so wrapped headers) with such a word, and the whole text. Tokens weigh
count * idf, idf = ln((1 + n) / (1 + df)) + 1 over the n templates, and tokens that no template has weigh the most, so
that prose around a notice lowers its cosine. A unit's tokens are sorted once and added up in one pass; a token finds its
weights in a table of BUCKETS buckets by its crc32. A document's own licence is that of its best unit at or over `least`
(ties: the first template's name). A document is a licence file of its directory if it has a licence and its name
says so, or if its whole text reaches `sure`. Documents without a licence of their own take that of the nearest directory above
them with a licence file; of several files, the highest cosine, then the smallest path, counts.

Directories, not documents, are joined to their ancestors; documents then meet their directory in one join. What the
texts say is written once to the shared folder.

Defined cases: a null text has no units; a null path has no directory and inherits nothing; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored; time grows with a text's length times its logarithm.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

# Licence texts, the notices that licences ask for, and their openings, as their authors publish them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
BOOST = 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)'


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


GNU = (("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"))
CREATIVE = (("CC-BY-4.0", "Attribution 4.0", "BY 4.0"), ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0", "BY-NC 4.0"), ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0", "BY-SA 4.0"))
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE.partition(" You may obtain")[0]),
    ("Apache-2.0", APACHE),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", BSD_HEAD.partition(" 1. ")[0]),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}"),
    ("BSL-1.0", BOOST),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC.partition(" THE SOFTWARE")[0]),
    ("ISC", ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT.partition(" (the ")[0] + "."),
    ("MIT", MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
    *((name, f"This work is licensed under the Creative Commons {long} International License.") for name, long, _ in CREATIVE),
    *((name, f"Licensed under CC {short}.") for name, _, short in CREATIVE),
    *((name, _gnu(long, version)) for name, long, version in GNU),
    *((name, _gnu(long, version).partition(", or (at")[0] + ".") for name, long, version in GNU),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")),
)
MARK = "[Ll][Ii][Cc][Ee][Nn][CcSs]|[Cc]opyright|[Pp]ermission (is|to)|[Rr]edistribut|[Ff]ree software|[Pp]ublic domain"
EMPTY_LINE = "\\n([ \\t\\r]*\\n)+"
BUCKETS = 1024
TOKEN = "[a-z0-9]+"
NAME = "(^|/)([Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|COPYING|NOTICE|UNLICENSE)[^/]*$"


def _weights() -> tuple[dict[str, float], list[dict[str, float]], float]:
    """idf by token, each template's unit vector, and the idf of a token in none."""
    bags = [Counter(re.findall(TOKEN, t.lower())) for _, t in TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in sorted(df.items())}
    out = []
    for b in bags:
        v = {w: n * idf[w] for w, n in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / size for w, x in v.items()})
    return idf, out, math.log(1 + len(bags)) + 1


def _table() -> Column:
    """By the crc32 of a token: array<struct<w, x>>, where x holds the idf and then the weight in each template."""
    idf, vectors, _ = _weights()
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for w, x in idf.items():
        buckets[zlib.crc32(w.encode()) % BUCKETS].append({"w": w, "x": [x, *[v.get(w, 0) for v in vectors]]})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<w:string,x:array<double>>>>")


def _best(units: Column) -> Column:
    """For each of the units struct<score, neg> of the most similar template; neg is the template's index, negative."""
    n, unknown = len(TEMPLATES), math.log(1 + len(TEMPLATES)) + 1
    table = _table()
    none = F.expr("cast(null as array<double>)")

    def one(unit: Column) -> Column:
        tokens = F.array_sort(F.regexp_extract_all(F.lower(unit), F.lit(TOKEN), F.lit(0)))

        def add(a: Column, w: Column) -> Column:
            again = w.eqNullSafe(a["last"])
            row = F.when(again, a["row"]).otherwise(F.get(F.transform(F.filter(F.get(table, (F.crc32(w.cast("binary")) % BUCKETS).cast("int")), lambda x: x["w"] == w), lambda x: x["x"]), F.lit(0)))
            c = F.when(again, a["c"] + 1).otherwise(F.lit(1))
            return F.struct(w.alias("last"), c.alias("c"), row.alias("row"), a["norm"].alias("norm"), a["dots"].alias("dots"))

        def weigh(a: Column) -> Column:
            idf = F.coalesce(a["row"][0], F.lit(unknown))
            dots = F.when(a["row"].isNull(), a["dots"]).otherwise(F.zip_with(a["dots"], F.slice(a["row"], 2, n), lambda x, y: x + idf * y))
            return F.struct(a["last"].alias("last"), a["c"].alias("c"), a["row"].alias("row"), (a["norm"] + (2 * a["c"] - 1) * idf * idf).alias("norm"), dots.alias("dots"))

        def step(a: Column, w: Column) -> Column:
            return F.transform(F.array(add(a, w)), weigh)[0]

        def close(a: Column) -> Column:
            return F.array_max(F.transform(a["dots"], lambda d, i: F.struct(F.coalesce(F.round(F.try_divide(d, F.sqrt(a["norm"])), 6), F.lit(0.0)).alias("score"), (-i).alias("neg"))))

        start = F.struct(F.expr("cast(null as string)").alias("last"), F.lit(0).alias("c"), none.alias("row"), F.lit(0.0).alias("norm"), F.array_repeat(F.lit(0.0), n).alias("dots"))
        return F.aggregate(tokens, start, step, close)

    return F.transform(units, one)


def parent(path: Column) -> Column:
    """The directory of a path; null at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def units(text: Column) -> Column:
    """The text, its blocks of several lines and its lines, these with a licence word each; none without one."""
    marked = lambda xs: F.filter(xs, lambda x: x.rlike(MARK))
    blocks = F.filter(marked(F.split(text, EMPTY_LINE, -1)), lambda x: x.contains("\n"))
    return F.when(text.rlike(MARK), F.concat(F.array(text), blocks, marked(F.split(text, "\n", -1))))


def scan(docs: DataFrame, least: float = 0.6, sure: float = 0.9, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """doc_id, path, own_license, own_score, license and inherited_from (the directory; null unless inherited)."""
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.select("doc_id", "path", F.transform(F.array(_best(units(F.col("text")))), lambda x: F.struct(F.array_max(x).alias("best"), F.get(x, F.lit(0))["score"].alias("whole")))[0].alias("u"))
    ok = F.col("u.best.score") >= least
    own = own.select(
        "doc_id", "path", parent(F.col("path")).alias("dir"), F.when(ok, F.element_at(names, 1 - F.col("u.best.neg"))).alias("own_license"), F.when(ok, F.col("u.best.score")).alias("own_score"),
        F.coalesce(ok & (F.col("path").rlike(NAME) | (F.col("u.whole") >= sure)), F.lit(False)).alias("is_file"),
    )
    own = cut(own, "licenses")
    held = own.filter("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.max("own_score").alias("top"))
    first = own.filter("is_file AND dir IS NOT NULL").join(held, "dir").filter(F.col("own_score") == F.col("top")).groupBy("dir").agg(F.min(F.struct("path", "own_license")).alias("f"))
    first = first.select(F.col("dir").alias("above"), F.col("f.own_license").alias("given"))
    dirs = own.filter("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/", -1)
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    nearest = up.join(first, "above").groupBy("dir").agg(F.max(F.struct(F.length("above"), "above", "given")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("n_dir"), F.col("n.above").alias("above"), F.col("n.given").alias("given"))
    both = own.join(nearest, own["dir"] == nearest["n_dir"], "left")
    heir = F.col("own_license").isNull() & F.col("given").isNotNull()
    return both.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), F.when(heir, F.col("above")).alias("inherited_from"))


def with_path(docs: DataFrame) -> DataFrame:
    """doc_id, text, and path: source/lang/doc_id.txt (missing parts: _)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.select("doc_id", "text", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"))


def _sql() -> str:
    idf, vectors, unknown = _weights()
    rows = ", ".join(f"('{w}', {i}, {v[w]!r}::DOUBLE)" for i, v in enumerate(vectors) for w in sorted(v))
    idfs = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    names = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(TEMPLATES))
    return f"""
WITH v(w, t, x) AS (VALUES {rows}), f(w, idf) AS (VALUES {idfs}), names(t, license) AS (VALUES {names}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt' AS path FROM {{docs}}
), q AS (
  SELECT rid, text FROM d WHERE regexp_matches(text, '{MARK}')
), l AS (
  SELECT rid, unnest(us) AS unit, generate_subscripts(us, 1) AS n FROM (SELECT rid, [text] || list_filter(string_split_regex(text, '{EMPTY_LINE}'), lambda x: regexp_matches(x, '{MARK}') AND contains(x, chr(10)))
    || list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{MARK}')) AS us FROM q)
), k AS (
  SELECT rid, n, w, count(*) AS c FROM (SELECT rid, n, unnest(regexp_extract_all(lower(unit), '{TOKEN}')) AS w FROM l) GROUP BY ALL
), g AS (
  SELECT k.*, c * coalesce(f.idf, {unknown!r}::DOUBLE) AS weight FROM k LEFT JOIN f USING (w)
), m AS (
  SELECT rid, n, sqrt(sum(weight * weight)) AS size FROM g GROUP BY rid, n
), s AS (
  SELECT g.rid, g.n, v.t, round(sum(g.weight * v.x) / any_value(m.size), 6) AS score FROM g JOIN v USING (w) JOIN m ON m.rid = g.rid AND m.n = g.n GROUP BY g.rid, g.n, v.t
), y AS (
  SELECT rid, max(score) AS whole FROM s WHERE n = 1 GROUP BY rid
), b AS (
  SELECT rid, t, score FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, t) = 1
), o AS (
  SELECT d.rid, d.doc_id, d.path, regexp_replace(d.path, '/[^/]*$', '') AS dir, names.license AS own_license, b.score AS own_score,
    b.score IS NOT NULL AND (regexp_matches(d.path, '{NAME}') OR coalesce(y.whole, 0) >= 0.9) AS is_file
  FROM d LEFT JOIN b ON b.rid = d.rid AND b.score >= 0.6 LEFT JOIN names ON names.t = b.t LEFT JOIN y ON y.rid = d.rid
), h AS (
  SELECT dir, own_license AS given FROM o WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1
), a AS (
  SELECT o.rid, h.dir, h.given FROM o JOIN h ON o.dir = h.dir OR starts_with(o.dir, h.dir || '/') QUALIFY row_number() OVER (PARTITION BY o.rid ORDER BY length(h.dir) DESC) = 1
)
SELECT o.doc_id, o.path, o.own_license, o.own_score, coalesce(o.own_license, a.given) AS license,
  CASE WHEN o.own_license IS NULL THEN a.dir END AS inherited_from
FROM o LEFT JOIN a USING (rid)
"""


SQL = _sql()
