"""Licence scans: headers and licence files against templates, then inheritance from the nearest directory.

Native. The units of a text are its lines and paragraphs that speak of a licence, blocks of such paragraphs, and the whole text
of a licence file. Each different unit is scored once, however many texts have it: units and templates are sparse TF-IDF vectors
of all their words, with document frequencies over all documents, and their cosine is a join on terms. A file without a licence
of its own has that of the nearest directory above it that holds a licence file: directories, not files, are joined with their
ancestors' paths. Licence files are told by their names, and where names are numbers, by their whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.llm.op1_decontamination import SEPARATORS
from merkleframe.llm.text import LOWER, UPPER, ascii_lower, split_words
from merkleframe.session import table, written

#: Names and the statements that go with them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 license."),
)
#: Longer notices, headers and licence files' titles, as their publishers word them.
NOTICES = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""),
)
#: Endings that a licence's short identifier may have.
ENDINGS = {"GPL-3.0": ("-only", "-or-later"), "GPL-2.0": ("-only", "-or-later"), "LGPL-3.0": ("-only", "-or-later")}
#: Least cosine of a match; identifiers must be whole, as those of other licences differ by a word.
LEAST, EXACT = 0.75, 0.98
#: A line or paragraph is looked at if it has one of these. Every template has one.
CUE = r"(?i)licen[cs]e|copyright|public domain|spdx|permission|redistribut|warrant"
#: Between paragraphs: lines without an ASCII letter or digit, such as those of comment marks alone.
GAP = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
#: Names of licence files.
FILE = r"(?i)^(licen[cs]e|copying)(\.[a-z]+)?$"
#: Keys of a larger share of all rows than one in so many, and of over so many rows, are joined by broadcast: no more keys than SHARES.
SHARES, ROWS = 50_000, 1_000
#: So many terms are broadcast to the count of document frequencies; more are joined with it.
TERMS = 100_000


def templates() -> list[tuple[str, str, float]]:
    """(licence, text, least cosine) of every template."""
    names = sorted({name for name, _ in TEMPLATES + NOTICES})
    ids = [(n, f"SPDX-License-Identifier: {n}{end}") for n in names for end in ("", *ENDINGS.get(n, ()))]
    return [(*t, LEAST) for t in TEMPLATES + NOTICES] + [(*t, EXACT) for t in ids + [("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License")]]


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def units(text: Column, whole: Column, by_text: bool = False) -> Column:
    """The different lines, paragraphs and blocks of a text that have a cue, and all of it if ``whole``, or ``by_text`` and it has a cue."""
    text = F.translate(F.coalesce(text, F.lit("")), "\x01", " ")
    told = lambda x: x.rlike(CUE)
    paragraphs = F.split(text, GAP)
    blocks = F.split(F.array_join(F.transform(paragraphs, lambda x: F.when(told(x), x).otherwise("\x01")), "\n"), "\x01")
    all_of_it = F.array(text) if by_text else F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(told(text), F.array_distinct(F.concat(F.filter(F.split(text, "\n"), told), F.filter(paragraphs, told), F.filter(blocks, told), all_of_it))).when(whole, F.array(text))


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, uses, df) of ``terms`` (term, uses): in how many rows of ``docs`` each is."""
    every = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    if terms.count() <= TERMS:
        every = every.join(F.broadcast(terms.select("term")), "term", "left_semi")
    df = every.groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(df, "term", "left").fillna(0, ["df"])


def _facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (key, uses, ..), which has every key; keys of many rows, by ``uses``, apart."""
    limit = max((facts.agg(F.sum("uses")).first()[0] or 0) / SHARES, ROWS)
    hot = F.broadcast(facts.where(F.col("uses") > limit).drop("uses"))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("uses") <= limit).drop("uses"), key)
    return rows.join(hot, key).unionByName(rest)


def matches(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """(doc_id, version, licence, score, wholly) of each text of ``docs`` (doc_id, version, text, whole) that has a unit like a template: the best one, ties to the first name.

    ``wholly``: a unit that is all of the text is like a template.
    """
    spark = docs.sparkSession
    n = F.lit(docs.count())
    u = docs.select("doc_id", "version", "text", F.explode(units(F.col("text"), F.col("whole"), by_text)).alias("unit"))
    all_of_it = F.octet_length("unit") == F.octet_length(F.coalesce("text", F.lit("")))  # any other unit is shorter
    u = written(u.select("doc_id", "version", "unit", F.sha2("unit", 256).alias("unit_id"), all_of_it.alias("all_of_it")))
    one = u.groupBy("unit_id", "unit").agg(F.count("*").alias("uses"))
    term = written(one.select("unit_id", F.explode(_words(F.col("unit"))).alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("tf")))
    t = spark.range(1).select(F.posexplode(F.array(*(F.struct(F.lit(a).alias("licence"), F.lit(b).alias("text"), F.lit(c).alias("least")) for a, b, c in templates()))).alias("k", "t"))
    t = t.select("k", "t.licence", "t.least", F.explode(_words(F.col("t.text"))).alias("term")).groupBy("k", "licence", "least", "term").agg(F.count("*").alias("tf"))
    vocabulary = written(term.select("term").unionByName(t.select("term")).groupBy("term").agg(F.count("*").alias("uses")))
    idf = written(document_frequencies(docs, vocabulary).select("term", "uses", _idf(n, F.col("df")).alias("idf")))
    t = t.join(idf.drop("uses"), "term").withColumn("v", F.col("tf") * F.col("idf"))
    t = t.join(t.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")), "k").select("term", F.struct("k", "licence", "least", (F.col("v") / F.col("norm")).alias("v")).alias("o"))
    t = written(t.groupBy("term").agg(F.collect_list("o").alias("of")))  # of the templates' terms, some hundreds
    part = _facts(term, idf, "term").withColumn("w", F.col("tf") * F.col("idf")).join(F.broadcast(t), "term", "left")
    none = F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("least"), F.lit(0.0).alias("v")))
    # The row without a template carries the unit's own square, once for each term.
    part = part.select("unit_id", "w", F.explode(F.concat(none, F.coalesce("of", F.array().cast("array<struct<k:int,licence:string,least:double,v:double>>")))).alias("o"))
    part = part.groupBy("unit_id", F.col("o.k").alias("k"), F.col("o.licence").alias("licence"), F.col("o.least").alias("least")).agg(F.sum(F.col("w") * F.col("o.v")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("square"))
    near = F.struct("licence", "least", F.round("dot", 9).alias("dot"))
    scored = part.groupBy("unit_id").agg(F.max(F.when(F.col("k").isNull(), F.col("square"))).alias("square"), F.collect_list(F.when(F.col("k").isNotNull(), near)).alias("all"))
    cosines = F.transform("all", lambda x: F.struct((-F.round(x["dot"] / F.sqrt("square"), 6)).alias("low"), x["licence"].alias("licence"), x["least"].alias("least")))
    top = F.array_min(F.filter(cosines, lambda x: -x["low"] >= x["least"]))
    scored = scored.select("unit_id", top.alias("top")).where("top IS NOT NULL").select("unit_id", "top.low", "top.licence")
    uses = u.groupBy("unit_id").agg(F.count("*").alias("uses"))
    scored = written(scored.join(uses, "unit_id"))
    m = _facts(u.select("doc_id", "version", "unit_id", "all_of_it"), scored, "unit_id")
    m = m.groupBy("doc_id", "version").agg(F.min(F.struct("low", "licence")).alias("m"), F.max("all_of_it").alias("wholly"))
    return m.select("doc_id", "version", F.col("m.licence").alias("licence"), (-F.col("m.low")).alias("score"), "wholly")


def inherited(files: DataFrame) -> DataFrame:
    """(dir, inherited) for each directory of ``files`` (path, licence): the licence of the nearest directory, itself first, that holds a licence file.

    Licence files are those so named, and then those that a column ``wholly`` tells, if there is one; the first name of a directory gives.
    """
    told = F.coalesce("wholly", F.lit(False)) if "wholly" in files.columns else F.lit(False)
    f = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "licence", "path", told.alias("told"))
    f = f.withColumn("other", ~F.col("name").rlike(FILE))
    given = f.where(F.col("licence").isNotNull() & (~F.col("other") | F.col("told"))).groupBy("dir").agg(F.min(F.struct("other", "name", "licence")).alias("g"))
    given = given.select(F.col("dir").alias("above"), F.col("g.licence").alias("given"))
    d = f.where("path IS NOT NULL").select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    d = d.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts")))).withColumn("above", F.array_join(F.slice("parts", 1, F.col("depth")), "/"))
    return d.join(given, "above").groupBy("dir").agg(F.max_by("given", "depth").alias("inherited"))


def scan(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """(doc_id, path, own, score, inherited, licence) of every row of ``docs`` (doc_id, text, path).

    ``own``: the licence of its best unit, of its template's least cosine or more; ``licence``: own, or else inherited. A null
    text has no lines and a null path no directory. Rows that repeat a doc_id are matched each by its text. Empty in, empty out.

    ``by_text`` is for tables whose names tell nothing: a text that as a whole is like a template is a licence file too. One without
    a doc_id, or at the root, where nothing is known of its place, gives its licence to no other.
    """
    whole = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(FILE), F.lit(False))
    d = docs.select("doc_id", "path", "text", whole.alias("whole")).withColumn("version", F.xxhash64(F.coalesce("text", F.lit("")), "whole"))
    m = written(matches(d, by_text)).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("licence").alias("own"), "score", "wholly")
    out = d.select("doc_id", "path", "version").join(m, d["doc_id"].eqNullSafe(m["_id"]) & (d["version"] == m["_version"]), "left")
    out = out.select("doc_id", "path", "own", "score", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "wholly")
    wholly = [(F.col("wholly") & F.col("doc_id").isNotNull() & (F.col("dir") != "")).alias("wholly")] if by_text else []
    up = written(inherited(out.select("path", F.col("own").alias("licence"), *wholly)))
    return out.join(up, "dir", "left").select("doc_id", "path", "own", "score", "inherited", F.coalesce("own", "inherited").alias("licence"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", path.alias("path")), by_text=True)


QUERIES = {"op2_license_scan": op2_license_scan}

_SQL_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_VALUES = ", ".join("({}, '{}', '{}', {})".format(k, name, text.replace("'", "''"), least) for k, (name, text, least) in enumerate(templates()))
#: No document here is named as a licence file is: those that are wholly like a template are such files.
ORACLE = {
    "op2_license_scan": f"""
WITH t AS (SELECT * FROM (VALUES {_VALUES}) v(k, licence, text, least)),
tt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({_SQL_WORDS}) AS term FROM t) GROUP BY k, term),
n AS (SELECT count(*) AS n FROM documents),
clean AS (SELECT doc_id, replace(text, chr(1), ' ') AS text FROM documents WHERE regexp_matches(text, '{CUE}')),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS lines, string_split_regex(text, '{GAP}') AS paragraphs FROM clean),
blocks AS (SELECT doc_id, string_split(array_to_string(list_transform(paragraphs, lambda p: CASE WHEN regexp_matches(p, '{CUE}') THEN p ELSE chr(1) END), chr(10)), chr(1)) AS blocks FROM parts),
unit AS (SELECT DISTINCT doc_id, text FROM (SELECT doc_id, unnest(lines) AS text FROM parts UNION ALL SELECT doc_id, unnest(paragraphs) FROM parts UNION ALL SELECT doc_id, unnest(blocks) FROM blocks UNION ALL SELECT doc_id, text FROM clean) WHERE regexp_matches(text, '{CUE}')),
ut AS (SELECT unit, term, count(*) AS tf FROM (SELECT text AS unit, unnest({_SQL_WORDS}) AS term FROM (SELECT DISTINCT text FROM unit)) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_SQL_WORDS}) AS term FROM documents) WHERE term IN (SELECT term FROM tt UNION SELECT term FROM ut) GROUP BY term),
tv AS (SELECT k, term, tf * (ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1) AS v FROM tt LEFT JOIN df USING (term), n),
tn AS (SELECT k, sqrt(sum(v * v)) AS v_norm FROM tv GROUP BY k),
uv AS (SELECT unit, term, tf * (ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1) AS w FROM ut LEFT JOIN df USING (term), n),
un AS (SELECT unit, sqrt(sum(w * w)) AS w_norm FROM uv GROUP BY unit),
dots AS (SELECT unit, k, round(sum(w * v / v_norm), 9) AS dot FROM uv JOIN tv USING (term) JOIN tn USING (k) GROUP BY unit, k),
cosines AS (SELECT unit, licence, round(dot / w_norm, 6) AS score, least FROM dots JOIN un USING (unit) JOIN t USING (k)),
best AS (SELECT doc_id, licence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM unit JOIN cosines ON text = unit WHERE score >= least),
wholly AS (SELECT DISTINCT doc_id FROM clean JOIN cosines ON text = unit WHERE score >= least),
files AS (SELECT d.doc_id, concat_ws('/', d.source, d.lang, d.doc_id::VARCHAR) AS path, b.licence AS own, b.score, w.doc_id IS NOT NULL AS holds FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1 LEFT JOIN wholly w ON w.doc_id = d.doc_id),
places AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name FROM files),
given AS (SELECT dir AS above, min(struct_pack(name := name, own := own)).own AS given FROM places WHERE holds AND dir <> '' GROUP BY dir),
up AS (SELECT dir, arg_max(given, length(above)) AS inherited FROM (SELECT DISTINCT dir FROM places) JOIN given ON dir = above OR starts_with(dir, above || '/') GROUP BY dir)
SELECT doc_id, path, own, score, inherited, coalesce(own, inherited) AS licence FROM places LEFT JOIN up USING (dir)
"""
}
