import re

import duckdb
import pytest

import corpus_pipeline as C
from merkleframe.llm import registry
from merkleframe.session import written

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = written(stage(spark, docs, SF))
        if i < len(C.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.join(before, columns, "left_anti").count() == 0, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[5] > 0
    assert sorted(r.slot for r in docs.collect()) == list(range(sizes[5]))


def test_stages_on_odd_rows(spark, docs):
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() > 0, name


def test_no_benchmark_window_stays(spark):
    def windows(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w}

    sf = "/root/testdata/sf0.01"
    leaked = {x for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for x in windows(r["text"])}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: windows(r.text) for r in C.decontamination(spark, docs, sf).collect()}
    assert not any(w & leaked for w in kept.values())
    assert set(kept) == {r.doc_id for r in docs.collect() if not windows(r.text) & leaked}


def test_near_copies_of_five_words_and_80_percent_go(spark):
    def jaccard(a, b, size):
        x, y = ({tuple(t[i : i + size]) for i in range(len(t) - size + 1)} for t in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    rows, wanted = [], set()
    # Words in the text, which of them are changed in the copy, and whether that is near enough.
    for k, (n, edits, near) in enumerate([(50, [25], True), (95, [30, 45], True), (60, [30, 45], False)]):
        words = [f"d{k}w{i}" for i in range(n)]
        copy = [f"edited{i}" if i in edits else w for i, w in enumerate(words)]
        texts = " ".join(words), " ".join(copy)
        assert jaccard(*texts, 4) < 0.85 and (0.8 <= jaccard(*texts, 5) < 0.85) == near
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        wanted |= {2 * k} if near else {2 * k, 2 * k + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in C.near_duplicates(spark, df, SF).collect()} == wanted


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    got = registry.queries()[name](spark, SF).select(*columns)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_license_scan", "op7_line_dedup"])
def test_native_queries_run_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "ArrowEval"))
