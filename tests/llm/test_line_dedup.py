import hashlib
import re
from collections import defaultdict

import pytest

from merkleframe.llm import op7_line_dedup as O

BLANK = " \t\n\x0b\x0c\r"


def brute(corpus):
    first, holders = {}, defaultdict(set)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    for i, text, *_ in corpus:
        for line in (text or "").split("\n"):
            if i is not None and len(k := lower(line.strip(BLANK))) >= O.MIN_CHARS:
                holders[k].add(i)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, text, *_ in corpus:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or first.get(lower(x.strip(BLANK)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs, corpus):
    got = O.dedup_lines(docs)
    rows = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert sorted(rows, key=str) == brute(corpus)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "keep_runs"]


@pytest.mark.parametrize("hot", [1, 3, 40])
def test_salted_hashes(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(O, "HOT", hot)
    got = O.dedup_lines(docs)
    rows = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert sorted(rows, key=str) == brute(corpus)


def test_ranges_are_streamed_in_order(docs):
    from merkleframe.session import written

    line = docs.selectExpr("doc_id", "doc_id AS version", "1 AS pos", "xxhash64(text) AS h1", "xxhash64(source) AS h2")
    plans = []
    held, O.written = O.written, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df)
    try:
        O._repeats(written(line)).collect()
    finally:
        O.written = held
    (plan,) = plans
    # From the top: the window, its sort, and the range exchange; no other exchange of the lines.
    assert re.search(r"Window .*Sort \[h1.*Exchange rangepartitioning\(h1", plan, re.S)
    assert "hashpartitioning(h1" not in plan and plan.count("Window [") == 1


def test_runs_are_the_kept_lines(docs, corpus):
    texts = {(r[0], r[1]) for r in corpus}
    for r in O.dedup_lines(docs.withColumn("was", docs["text"])).collect():
        assert (r.doc_id, r.was) in texts
        lines = (r.was or "").split("\n")
        assert sum(x.len for x in r.keep_runs) == r.n_lines - r.n_dropped == len(lines) - r.n_dropped
        assert "\n".join(x for k in r.keep_runs for x in lines[k.start : k.start + k.len]) == (r.text or "")


def test_small_cases(spark, empty, crowded, unharmed):
    rows = [(2, "a common line\nb"), (1, "A COMMON LINE \n a common line"), (3, "short\nshort"), (4, None)]
    got = {r.doc_id: r.text for r in O.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "A COMMON LINE \n a common line", 2: "b", 3: "short\nshort", 4: None}
    assert O.dedup_lines(empty).count() == 0
    out = O.dedup_lines(crowded.drop("n_lines"))
    unharmed(out.drop("n_lines", "n_dropped", "keep_runs"), crowded.drop("n_lines"))
    assert out.count() == crowded.count()
