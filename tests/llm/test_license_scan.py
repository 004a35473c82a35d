import math
import re
from collections import Counter

import pytest

from merkleframe.llm import op2_license_scan as O


def test_headers_and_inheritance(spark):
    mit, apache = dict(O.TEMPLATES)["MIT"], dict(O.TEMPLATES)["Apache-2.0"]
    rows = [
        (1, f"intro text\n// {mit}\ncode", "r/a/x.py"), (2, "no statement at all", "r/a/y.py"), (3, apache, "r/LICENSE"), (4, "nothing", "r/b/c/z.py"),
        (5, mit.upper(), "r/b/LICENSE.txt"), (6, "nothing", "r/b/c/d/w.py"), (7, None, "r/q.py"), (8, "", None), (9, "a licence of some other kind entirely, written for one project", "s/t.py"),
        (None, apache, "s/u.py"), (11, "nothing", "top.py"), (4, "nothing", "r/b/c/z.py"), (12, "The licence fee for television rose.", "r/a/LICENSES/v.py"),
    ]
    got = [(r.doc_id, r.path, r.own, r.inherited, r.licence) for r in O.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "r/a/x.py", "MIT", "Apache-2.0", "MIT"), (2, "r/a/y.py", None, "Apache-2.0", "Apache-2.0"), (3, "r/LICENSE", "Apache-2.0", "Apache-2.0", "Apache-2.0"),
        (4, "r/b/c/z.py", None, "MIT", "MIT"), (4, "r/b/c/z.py", None, "MIT", "MIT"), (5, "r/b/LICENSE.txt", "MIT", "MIT", "MIT"), (6, "r/b/c/d/w.py", None, "MIT", "MIT"),
        (7, "r/q.py", None, "Apache-2.0", "Apache-2.0"), (8, None, None, None, None), (9, "s/t.py", None, None, None), (None, "s/u.py", "Apache-2.0", None, "Apache-2.0"),
        (11, "top.py", None, None, None), (12, "r/a/LICENSES/v.py", None, "Apache-2.0", "Apache-2.0"),
    ], key=str)


def test_each_template_is_its_own(spark):
    rows = [(i, text, "p") for i, (_, text) in enumerate(O.TEMPLATES)]
    got = {r.doc_id: (r.own, r.score) for r in O.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {i: (name, 1.0) for i, (name, _) in enumerate(O.TEMPLATES)}


def test_empty_and_odd(spark, docs, empty):
    from pyspark.sql import functions as F

    assert O.scan(empty.withColumn("path", F.lit("x"))).count() == 0
    assert {r.own for r in O.scan(docs.withColumn("path", F.lit("x"))).collect()} == {None}


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(rows):
    """The licence and score of each text, by cosines of all its units with all templates."""
    n, df = len(rows), Counter(w for _, text, _ in rows for w in set(words(text)))

    def vector(text):
        return {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(words(text)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a else 0

    models = [(name, vector(text), least) for name, text, least in O.templates()]
    out = {}
    for i, text, path in rows:
        told = [x for x in (text or "").split("\n") if re.search(O.CUE, x)]
        paragraphs, block = re.split(O.GAP, text or ""), []
        for p in [*paragraphs, ""]:
            if re.search(O.CUE, p):
                told.append(p)
                block.append(p)
            elif block:
                told.append("\n".join(block))
                block = []
        if re.search(O.FILE, path.split("/")[-1]):
            told.append(text or "")
        found = [(-round(c, 5), name) for u in set(told) for name, v, least in models if (c := cosine(vector(u), v)) >= least]
        out[i] = min(found, default=(None, None))
    return out


def full(name):
    return max((text for n, text in O.NOTICES if n == name), key=len)


@pytest.fixture(scope="module")
def files():
    comment = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    mit = full("MIT").replace("The above", "\nThe above").replace("THE SOFTWARE IS", "\nTHE SOFTWARE IS", 1)
    return [
        (1, comment("Copyright (c) 2020 Some One\n\n" + mit, "//") + "\n\nint main() { return 0; }", "r/a/main.c"),
        (2, "#!/bin/sh\n#\n" + comment(full("Apache-2.0"), "#") + "\n#\nset -e\n" + "echo words\n" * 5000, "r/a/run.sh"),
        (3, "MIT License\n\nCopyright (c) 2021 Another\n\n" + mit, "r/LICENSE"),
        (4, "Copyright (c) 2019, The Authors\n\n" + full("BSD-3-Clause"), "r/b/LICENSE.md"),
        (5, "// SPDX-License-Identifier: MPL-2.0\nx = 1", "r/b/x.js"),
        (6, "// SPDX-License-Identifier: Zlib\nx = 1", "s/x.js"),
        (7, "/* SPDX-License-Identifier: GPL-2.0-or-later */", "s/y.c"),
        (8, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy this.\n" * 3, "t/COPYING"),
        (9, "He asked for permission to leave, and the warrant was signed at noon.", "t/u/story.txt"),
        (10, None, "t/u/none"), (11, "", "t/u/LICENSE"), (12, full("ISC") + "\x01", "t/v.c"), (13, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "v.go"),
        (14, full("GPL-3.0"), "w.py"), (15, "This text is free: anyone may read it, and no licence is needed to do so.", "w/LICENSE"),
    ]


@pytest.mark.parametrize("rows, terms", [(O.ROWS, O.TERMS), (1, 10)])
def test_headers_and_licence_files(spark, files, monkeypatch, rows, terms):
    monkeypatch.setattr(O, "ROWS", rows)
    monkeypatch.setattr(O, "TERMS", terms)
    monkeypatch.setattr(O, "SHARES", 200)
    got = {r.doc_id: r for r in O.scan(spark.createDataFrame(files, "doc_id long, text string, path string")).collect()}
    want = brute(files)
    assert len(got) == len(files)
    for i, (low, name) in want.items():
        assert (got[i].own, got[i].score) == (name, pytest.approx(None if low is None else -low, abs=2e-5))
    assert {i: r.own for i, r in got.items() if r.own} == {
        1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: "BSD-3-Clause", 5: "MPL-2.0", 7: "GPL-2.0", 8: "GPL-3.0", 12: "ISC", 13: "BSD-3-Clause", 14: "GPL-3.0",
    }
    assert {i: got[i].inherited for i in (1, 5, 9, 6, 15)} == {1: "MIT", 5: "BSD-3-Clause", 9: "GPL-3.0", 6: None, 15: None}


def test_every_template_has_a_cue():
    assert all(re.search(O.CUE, text) for _, text, _ in O.templates())


def test_nearest_of_random_directories(spark):
    import random

    rng = random.Random(2)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(300)]
    rows = sorted({(f"{d}/{name}".lstrip("/"), licence) for d in paths for name, licence in [rng.choice([("LICENSE", "MIT"), ("copying.txt", "ISC"), ("x.py", None), ("y.py", "MIT")])]}, key=str)
    given = {}
    for path, licence in rows:
        d, _, name = path.rpartition("/")
        if licence and re.search(O.FILE, name):
            given[d] = min(given.get(d, (name, licence)), (name, licence))
    want = {}
    for path, _ in rows:
        d = path.rpartition("/")[0]
        parts = d.split("/") if d else []
        above = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]
        want[d] = next((given[a][1] for a in above if a in given), None)
    got = {r.dir: r.inherited for r in O.inherited(spark.createDataFrame(rows, "path string, licence string")).collect()}
    assert got == {d: x for d, x in want.items() if x}


def test_clashing_names(spark, crowded):
    from pyspark.sql import functions as F

    for name in ("unit", "unit_id", "whole", "term", "uses", "df", "idf", "k", "m"):
        crowded = crowded.withColumn(name, F.lit("x"))
    assert O.scan(crowded.withColumn("path", F.lit("x"))).count() == crowded.count()


def test_licence_files_by_text(spark):
    mit, apache, gpl, bsd = (dict(O.TEMPLATES)[x] for x in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"))
    rows = [
        (1, f"Some words.\n{mit}", "a/en/1"), (2, "nothing", "a/en/2"), (3, "words " * 40 + f"\n{apache}", "a/en/3"), (4, None, "a/fr/4"), (5, gpl, "a/5"), (6, "nothing", "a/6"), (7, "nothing", "b/en/7"),
        (8, "words " * 40 + f"\n{apache}", "b/en/8"), (9, apache, "9"), (None, mit, "b/en"), (11, "nothing", "b/11"), (12, apache, "c/en/12"), (13, gpl, "c/en/13"), (14, "nothing", "c/en/14"),
        (15, full("BSD-3-Clause").replace("\n", "\n\n") + "\n\nAdded at the end.", "d/en/15"), (16, "nothing", "d/en/16"), (17, apache, "e/17"), (18, bsd, "e/LICENSE"), (19, "nothing", "e/en/19"), (20, "nothing", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.own, r.inherited, r.licence) for r in O.scan(df, by_text=True).collect()}
    assert got == {
        1: ("MIT", "MIT", "MIT"), 2: (None, "MIT", "MIT"), 3: ("Apache-2.0", "MIT", "Apache-2.0"), 4: (None, "GPL-3.0", "GPL-3.0"), 5: ("GPL-3.0", "GPL-3.0", "GPL-3.0"), 6: (None, "GPL-3.0", "GPL-3.0"), 7: (None, None, None),
        8: ("Apache-2.0", None, "Apache-2.0"), 9: ("Apache-2.0", None, "Apache-2.0"), None: ("MIT", None, "MIT"), 11: (None, None, None), 12: ("Apache-2.0", "Apache-2.0", "Apache-2.0"), 13: ("GPL-3.0", "Apache-2.0", "GPL-3.0"), 14: (None, "Apache-2.0", "Apache-2.0"),
        15: ("BSD-3-Clause",) * 3, 16: (None, "BSD-3-Clause", "BSD-3-Clause"), 17: ("Apache-2.0", "BSD-3-Clause", "Apache-2.0"), 18: ("BSD-3-Clause",) * 3, 19: (None, "BSD-3-Clause", "BSD-3-Clause"), 20: (None, None, None),
    }
    assert {r.inherited for r in O.scan(df).collect()} == {None, "BSD-3-Clause"}


def test_the_query_inherits(spark, tmp_path):
    import duckdb

    mit, apache, gpl = (dict(O.TEMPLATES)[x] for x in ("MIT", "Apache-2.0", "GPL-3.0"))
    rows = [
        (1, f"Some words.\n{mit}", "en", "a"), (2, "nothing", "en", "a"), (3, "words " * 40 + f"\n{apache}", "en", "a"), (4, "nothing", "fr", "a"), (5, gpl, None, "a"), (6, "nothing", None, "a"), (7, "", "en", "b"),
        (8, None, "en", "b"), (9, apache, None, None), (10, "nothing", None, None), (11, mit, "de", "ab"), (12, "nothing", "de", "ab"), (13, f"One.\n\n{gpl}\n\nTwo.", "es", "b"), (14, "nothing", "es", "b"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(O.ORACLE["op2_license_scan"])
    names = [c[0] for c in want.description]
    got = O.op2_license_scan(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert {r.doc_id: r.inherited for r in got if r.inherited} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "GPL-3.0", 5: "GPL-3.0", 6: "GPL-3.0", 11: "MIT", 12: "MIT", 13: "GPL-3.0", 14: "GPL-3.0"}
