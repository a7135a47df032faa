"""Licence scans in DataFrame expressions alone.

Stretches of a whole text, and whole licence files, are compared with the templates by the cosine of sparse
TF-IDF vectors. Terms are `[a-z0-9]+` of the lower-cased text, so that line breaks and comment signs do not matter;
a term's weight is its count times ln((1 + N) / (1 + documents with it)) + 1, the counts taken over all documents for
the templates' terms and 0 for any other term. Templates and their terms are a fixed list, so that all that goes to the
driver is one count for each of them.

Each template has words of its own that a match must hold. Wherever the first of them stands in the text, a window of
the template's length is laid so that this word stands as it does in the template, and is compared. A file that
holds the own words of a full licence text, and has at most twice its length, is compared as a whole too. Of the comparisons with a
cosine of `LEAST` or more, the one with the most weight (cosine times the template's norm, so that a long notice goes before the
sentences in it) names the file's licence; ties: the earlier template, then the earlier place. A tag
`SPDX-License-Identifier:` goes before all of them, with the expression that stands there and a score of 1.

A licence file of its directory is a file that as a whole is like a licence text, or of which the match is at least half of the words,
or that has within its first `TOP` words the title of a licence too long to be listed. The best of a directory's (by
weight, then the earlier template) is the directory's licence. A file without a licence of its own inherits from the
nearest ancestor directory that has one, its own directory being the nearest: distinct directories are joined with the licences by each
of their prefixes, the longest match wins, and files join their directory.

Null or empty text has no licence of its own. Null parts of a path are `-`. Rows are scanned one by one, so repeated
rows give repeated results; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.plans.joins import broadcast_if_small
from matloom.plans.materialize import cut

LEAST, TOP = 0.6, 30
TERM = "[a-z0-9]+"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([A-Za-z0-9.+()-]+(?: (?:and|or|with) [A-Za-z0-9.+()-]+)*)"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FSF = "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_LATER = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Licence, kind (notice, title of a longer text, full text), words that a match must hold (the first one places it), wording.
TEMPLATES = [
    ("Apache-2.0", "notice", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "mit license", "Released under the MIT License."),
    ("GPL-3.0", "notice", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "notice", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "notice", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "cc nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "notice", "cc sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "notice", "cc by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "notice", "creative noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "creative sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "notice", "creative attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "notice", "cc0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "notice", "reserved rights all", "All rights reserved."),
    ("Apache-2.0", "notice", "apache compliance", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "notice", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + _LATER.format(3)),
    ("LGPL-3.0", "notice", "gnu lesser 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _LATER.format(3)),
    ("AGPL-3.0", "notice", "gnu affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + _LATER.format(3)),
    ("GPL-2.0", "notice", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + _LATER.format(2)),
    ("MPL-2.0", "notice", "mozilla subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "notice", "bsd governed", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "title", "apache 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("GPL-3.0", "title", "verbatim general 29", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _FSF),
    ("LGPL-3.0", "title", "verbatim lesser 29", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _FSF),
    ("AGPL-3.0", "title", "verbatim affero 19", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _FSF),
    ("GPL-2.0", "title", "verbatim general 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA "
     "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "title", "mozilla definitions", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("CC0-1.0", "title", "cc0 universal", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
    ("MIT", "text", "sublicense merchantability", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", "text", "redistribution merchantability", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", "text", "redistribution endorse merchantability", _BSD + _BSD_ENDORSE + _BSD_AS_IS),
    ("ISC", "text", "fee disclaims", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "notice", "sublicense granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("BSD", "notice", "redistribution permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("ISC", "notice", "distribute permission granted", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted."),
    ("ISC", "notice", "distribute permission fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "notice", "unencumbered", "This is free and unencumbered software released into the public domain."),
]


def terms(notice: str) -> list[str]:
    return re.findall(TERM, notice.lower())


VOCABULARY = sorted({t for *_, n in TEMPLATES for t in terms(n)})
KEYS = sorted({own.split()[0] for _, _, own, _ in TEMPLATES})
HINT = "(?<![a-z0-9])(?:" + "|".join(KEYS) + ")(?![a-z0-9])"


def document_counts(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each term of the templates."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), F.lit(1)))
    known = F.array_intersect(words, F.array(*map(F.lit, VOCABULARY)))
    # An empty string stands for the document itself.
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(known, F.array().cast("array<string>")))).alias("t")).groupBy("t").count().collect()
    counts = {r[0]: r[1] for r in rows}
    return counts.pop("", 0), counts


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


class Weights:
    """Terms' weights over a corpus, and the templates' vectors, as SQL literals."""

    def __init__(self, n: int, df: dict[str, int]):
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.other = f"{math.log(1 + n) + 1!r}D"
        self.map = "map(" + ", ".join(f"'{t}', {w!r}D" for t, w in self.idf.items()) + ")"
        self.vectors = [{t: k * self.idf[t] for t, k in Counter(terms(text)).items()} for *_, text in TEMPLATES]
        self.norms = [math.sqrt(sum(v * v for v in x.values())) for x in self.vectors]

    def templates(self) -> str:
        each = []
        for i, (_, kind, own, text) in enumerate(TEMPLATES):
            t, needs = terms(text), own.split()
            vector = ", ".join(f"named_struct('t', '{w}', 'v', {v!r}D)" for w, v in self.vectors[i].items())
            each.append(f"named_struct('rank', {i}, 'kind', '{kind}', 'key', '{needs[0]}', 'at', {t.index(needs[0])}, 'n', {len(t)}, 'needs', {_strings(needs)}, 'terms', array({vector}), 'norm', {self.norms[i]!r}D)")
        return "array(" + ", ".join(each) + ")"


def detect(files: DataFrame, w: Weights) -> DataFrame:
    """doc_id, path, n (words), spdx, hits (weight, rank and start negative, score, cover, kind), tokens (of files that may be licence texts as a whole)."""
    keys = ", ".join(f"'{k}'" for k in KEYS)
    fulls = ", ".join(_strings(own.split()) for _, kind, own, _ in TEMPLATES if kind == "text")
    rows = files.select("doc_id", "path", F.lower("text").alias("low"), F.regexp_extract("text", SPDX, 1).alias("spdx"), F.expr(w.map).alias("weights"), F.expr(w.templates()).alias("templates"))
    steps = [
        ("tokens", f"CASE WHEN low RLIKE '{HINT}' THEN regexp_extract_all(low, '({TERM})', 1) END"),
        ("places", f"filter(transform(tokens, (t, i) -> CASE WHEN t IN ({keys}) THEN i ELSE -1 END), i -> i >= 0)"),
        ("hits", "flatten(transform(places, p -> transform(filter(templates, t -> t.key = get(tokens, p)), t -> struct(t AS t, greatest(p - t.at, 0) AS start))))"),
        ("hits", "transform(hits, x -> struct(x.t AS t, x.start AS start, slice(tokens, x.start + 1, x.t.n) AS w))"),
        ("hits", "filter(hits, x -> forall(x.t.needs, y -> array_contains(x.w, y)))"),
        ("hits", f"transform(hits, x -> struct(x.t AS t, x.start AS start, size(x.w) AS cover, transform(array_distinct(x.w), t -> struct(t AS t, size(filter(x.w, y -> y = t)) * coalesce(element_at(weights, t), {w.other}) AS v)) AS tv))"),
        ("hits", "transform(hits, x -> struct(x.t AS t, x.start AS start, x.cover AS cover, map_from_entries(x.tv) AS m, sqrt(aggregate(x.tv, 0D, (a, e) -> a + e.v * e.v)) AS norm))"),
        ("hits", "transform(hits, x -> struct(x.t.rank AS rank, x.t.kind AS kind, x.t.norm AS size, x.start AS start, x.cover AS cover, round(aggregate(x.t.terms, 0D, (a, e) -> a + e.v * coalesce(element_at(x.m, e.t), 0D)) / (x.norm * x.t.norm), 6) AS score))"),
        ("hits", f"transform(filter(hits, x -> x.score >= {LEAST}), x -> struct(round(x.score * x.size, 6) AS weight, -x.rank AS rank, -x.start AS start, x.score AS score, x.cover AS cover, x.kind AS kind))"),
        ("n", "CASE WHEN tokens IS NOT NULL THEN size(tokens) ELSE 0 END"),
        ("tokens", f"CASE WHEN exists(array({fulls}), needs -> forall(needs, y -> array_contains(tokens, y))) THEN tokens END"),
    ]
    for name, e in steps:
        rows = rows.withColumn(name, F.expr(e))
    return rows.select("doc_id", "path", "n", F.nullif("spdx", F.lit("")).alias("spdx"), "hits", "tokens")


def whole_files(found: DataFrame, w: Weights) -> DataFrame:
    """rid, whole: the best comparison (weight, negative rank, score) of a whole file with a full text; sparse vectors, joined by terms with fixed tables."""
    texts = [i for i, t in enumerate(TEMPLATES) if t[1] == "text"]
    fixed = lambda rows: found.sparkSession.range(1).select(F.inline(F.expr(f"array({', '.join(rows)})")))
    entries = fixed([f"named_struct('t', '{t}', 'rank', {i}, 'tv', {v!r}D)" for i in texts for t, v in w.vectors[i].items()])
    heads = fixed([f"named_struct('rank', {i}, 'size', {w.norms[i]!r}D, 'most', {2 * len(terms(TEMPLATES[i][3]))}, 'needs', {_strings(TEMPLATES[i][2].split())})" for i in texts])
    idf = fixed([f"named_struct('t', '{t}', 'idf', {v!r}D)" for t, v in w.idf.items()])
    counts = found.where("tokens IS NOT NULL").select("rid", "n", F.explode("tokens").alias("t")).groupBy("rid", "n", "t").agg(F.count(F.lit(1)).alias("k"))
    vectors = counts.join(F.broadcast(idf), "t", "left").select("rid", "n", "t", (F.col("k") * F.coalesce("idf", F.expr(w.other))).alias("v"))
    norms = vectors.groupBy("rid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = vectors.join(F.broadcast(entries), "t").groupBy("rid", "n", "rank").agg(F.sum(F.col("v") * F.col("tv")).alias("dot"), F.collect_set("t").alias("terms"))
    scored = dots.join(norms, "rid").join(F.broadcast(heads), "rank").where("n <= most AND forall(needs, y -> array_contains(terms, y))")
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).where(F.col("score") >= LEAST)
    return scored.groupBy("rid").agg(F.max(F.struct(F.round(F.col("score") * F.col("size"), 6).alias("weight"), (-F.col("rank")).alias("rank"), "score")).alias("whole"))


def scan(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, own (the file's licence), score, inherited, from_dir, license: one row per row."""
    files = docs.select("doc_id", path.alias("path"), "text")
    w = Weights(*document_counts(files))
    names = F.array(*[F.lit(n) for n, *_ in TEMPLATES])
    found = cut(detect(files, w).withColumn("rid", F.monotonically_increasing_id()), "found")
    best = F.array_max(F.col("hits"))
    at_top = F.array_max(F.expr(f"filter(hits, h -> h.cover * 2 >= n OR h.kind = 'title' AND -h.start < {TOP})"))
    hit = lambda c: F.when(c.isNotNull(), F.struct(c["weight"].alias("weight"), c["rank"].alias("rank"), c["score"].alias("score")))
    found = found.hint("merge").join(broadcast_if_small(cut(whole_files(found, w), "whole")), "rid", "left")
    found = found.select(
        "doc_id", "path", "spdx", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.greatest(hit(best), "whole").alias("hit"), F.greatest(hit(at_top), "whole").alias("file")
    )
    by_dir = found.where("file IS NOT NULL").groupBy("dir").agg(F.max("file").alias("best")).select(F.col("dir").alias("from_dir"), F.get(names, -F.col("best.rank")).alias("inherited"))
    by_dir = broadcast_if_small(cut(by_dir, "by_dir"))
    parts = F.split("dir", "/")
    above = found.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("from_dir")).distinct()
    nearest = above.hint("merge").join(by_dir, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "inherited")).alias("near")).select("dir", "near.from_dir", "near.inherited")
    rows = found.hint("merge").join(broadcast_if_small(cut(nearest, "nearest")), "dir", "left")
    own = F.coalesce("spdx", F.get(names, -F.col("hit.rank")))
    lone = own.isNull()
    score = F.when(F.col("spdx").isNotNull(), F.lit(1.0)).otherwise(F.col("hit.score"))
    return rows.select("doc_id", "path", own.alias("own"), score.alias("score"), F.when(lone, F.col("inherited")).alias("inherited"), F.when(lone, F.col("from_dir")).alias("from_dir"), F.coalesce(own, F.col("inherited")).alias("license"))


def _values() -> str:
    each = [(i, name, kind, own.split(), terms(text)) for i, (name, kind, own, text) in enumerate(TEMPLATES)]
    return ", ".join(f"({i}, '{name}', '{kind}', {needs}, {needs[0]!r}, {words.index(needs[0])}, {words})" for i, name, kind, needs, words in each)


#: The same rows in DuckDB, for files at source/lang/(the digits of doc_id but the last, one directory each)/doc_id.
SCAN_SQL = f"""
WITH tpl(rank, name, kind, needs, word, off, words) AS (VALUES {_values()}),
tt AS (SELECT rank, t, count(*)::DOUBLE AS k FROM (SELECT rank, unnest(words) AS t FROM tpl) GROUP BY ALL),
f AS (SELECT row_number() OVER () AS rid, doc_id, text, lower(text) AS low, dir, dir || '/' || coalesce(doc_id::VARCHAR, '-') AS path FROM (SELECT *, coalesce(source, '-') || '/' || coalesce(lang, '-')
    || CASE WHEN doc_id >= 10 THEN regexp_replace((doc_id // 10)::VARCHAR, '(.)', '/\\1', 'g') ELSE '' END AS dir FROM documents)),
n AS (SELECT count(*)::DOUBLE AS n FROM f),
df AS (SELECT t, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(low, '{TERM}'))) AS t FROM f) WHERE t IN (SELECT t FROM tt) GROUP BY t),
idf AS (SELECT DISTINCT t, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM tt LEFT JOIN df USING (t), n),
tv AS MATERIALIZED (SELECT rank, t, k * w AS v, sqrt(sum(k * w * k * w) OVER (PARTITION BY rank)) AS norm FROM tt JOIN idf USING (t)),
c AS MATERIALIZED (SELECT rid, regexp_extract_all(low, '{TERM}') AS w FROM f WHERE regexp_matches(low, '(^|[^a-z0-9])(?:{"|".join(KEYS)})([^a-z0-9]|$)')),
p AS (SELECT rid, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM c),
x AS MATERIALIZED (SELECT row_number() OVER () AS xid, * FROM (SELECT p.rid, tpl.rank, tpl.kind, greatest(p.p - off, 0) AS start, c.w[greatest(p.p - off, 0) + 1 : greatest(p.p - off, 0) + len(words)] AS w, needs
    FROM p JOIN tpl ON p.t = tpl.word JOIN c ON c.rid = p.rid) WHERE list_has_all(w, needs)
    UNION ALL SELECT -row_number() OVER (), rid, rank, 'whole', 0, w, needs FROM c, tpl WHERE kind = 'text' AND len(w) <= 2 * len(words) AND list_has_all(w, needs)),
xv AS MATERIALIZED (SELECT xid, rank, xt.t, k * coalesce(w, (SELECT ln(1 + n) + 1 FROM n)) AS v FROM (SELECT xid, rank, t, count(*) AS k FROM (SELECT xid, rank, unnest(w) AS t FROM x) GROUP BY ALL) xt LEFT JOIN idf USING (t)),
xn AS (SELECT xid, sqrt(sum(v * v)) AS norm FROM xv GROUP BY xid),
s AS (SELECT xv.xid, any_value(tv.norm) AS size, round(sum(xv.v * tv.v) / (any_value(xn.norm) * any_value(tv.norm)), 6) AS score FROM xv JOIN tv ON tv.t = xv.t AND tv.rank = xv.rank JOIN xn ON xn.xid = xv.xid GROUP BY xv.xid),
h AS (SELECT x.rid, x.rank, x.start, s.score, round(s.score * s.size, 6) AS weight, x.kind = 'whole' OR x.kind = 'title' AND x.start < {TOP} OR len(x.w) * 2 >= len(c.w) AS file FROM x JOIN s USING (xid) JOIN c ON c.rid = x.rid WHERE s.score >= {LEAST}),
o AS (SELECT rid, rank, score FROM h QUALIFY row_number() OVER (PARTITION BY rid ORDER BY weight DESC, rank, score DESC) = 1),
d AS (SELECT f.dir AS from_dir, h.rank FROM h JOIN f USING (rid) WHERE h.file QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY weight DESC, h.rank, score DESC) = 1),
a AS (SELECT dirs.dir, d.from_dir, d.rank FROM (SELECT DISTINCT dir FROM f) dirs JOIN d ON dirs.dir = d.from_dir OR starts_with(dirs.dir, d.from_dir || '/') QUALIFY row_number() OVER (PARTITION BY dirs.dir ORDER BY length(d.from_dir) DESC) = 1),
g AS (SELECT f.rid, nullif(regexp_extract(f.text, '{SPDX}', 1), '') AS spdx FROM f)
SELECT doc_id, path, coalesce(spdx, tpl.name) AS own, CASE WHEN spdx IS NOT NULL THEN 1.0::DOUBLE ELSE o.score END AS score,
    CASE WHEN spdx IS NULL AND tpl.name IS NULL THEN near.name END AS inherited, CASE WHEN spdx IS NULL AND tpl.name IS NULL THEN a.from_dir END AS from_dir, coalesce(spdx, tpl.name, near.name) AS license
FROM f JOIN g USING (rid) LEFT JOIN o USING (rid) LEFT JOIN tpl ON tpl.rank = o.rank LEFT JOIN a ON a.dir = f.dir LEFT JOIN tpl near ON near.rank = a.rank
"""
