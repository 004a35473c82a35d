import random
import re

import pytest

from merkleframe.llm import op1_decontamination as O

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in SPLIT.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(corpus, items):
    out = []
    for i, text, *_ in corpus:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(len(b), O.WINDOW)
            for k in range(len(b) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted(corpus):
    rng = random.Random(5)
    items = [(1, corpus[0][1]), (2, "Two words"), (10, "é, Ü ñ"), (3, None), (4, "..."), (5, " ".join(corpus[1][1].split()[:20])), (6, "nobody wrote this item at all, it has quite a few words in it")]
    rows = list(corpus[:40]) + list(corpus[165:179]) + list(corpus[180:])
    for i in range(1000, 1010):
        w = words(corpus[0][1])
        at = rng.randrange(len(w) - 15)
        rows.append((i, corpus[50 + i % 10][1] + " -- " + " ".join(w[at : at + 10 + i % 8]).upper() + "!", "en", "a", 0))
    rows.append((1020, " ".join(f"w{i}" for i in range(400)) + " " + " ".join(words(corpus[0][1])[3:17]), "en", "a", 0))  # under a twentieth
    return rows, items


def test_against_brute_force(spark, planted):
    rows, items = planted
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r.items)) for r in O.hits(d, b).collect() for _ in range(r.copies)]
    assert sorted(got, key=str) == brute(rows, items)


def test_shuffled_join_is_the_same(spark, planted, monkeypatch):
    rows, items = planted
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, O.hits(d, b).collect()))
    monkeypatch.setattr(O, "MAX_BROADCAST", 0)
    assert sorted(map(str, O.hits(d, b).collect())) == want


def test_removal(spark, planted, crowded, unharmed):
    rows, items = planted
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {str((r[0], r[1])) for r in brute(rows, items) if r[2] and 20 * r[2] >= r[1]}
    kept = O.remove(d, b, share=True)
    assert kept.columns == d.columns and kept.count() == len(rows) - sum(str((r[0], len(words(r[1])))) in bad for r in rows)
    hit = {str((r[0], r[1])) for r in brute(rows, items) if r[2]}
    assert len(hit) > len(bad)
    assert O.remove(d, b).count() == len(rows) - sum(str((r[0], len(words(r[1])))) in hit for r in rows)
    cut = O.remove(d, b, "spans")
    assert cut.count() == len(rows)
    clean = [(r.doc_id, r.text) for r in cut.collect()]
    hit = {(r[0], r[1]): r[2] for r in brute(rows, items)}
    for r in rows:
        assert any(i == r[0] and len(words(t)) == len(words(r[1])) - hit[r[0], len(words(r[1]))] for i, t in clean)
    for mode in ("documents", "spans"):
        unharmed(O.remove(crowded, b, mode), crowded)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert O.hits(empty, none).count() == 0
    assert {(r.n_hit, tuple(r.items)) for r in O.hits(docs, none).collect()} == {(0, ())}
    assert O.remove(docs, none).count() == docs.count()
