import re
from collections import defaultdict

import pytest

from merkleframe.llm import components as C, op6_ngram_join as O
from merkleframe.llm.components import components


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split() if text else []
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", " ".join(w)) if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if 100 * len(s & t) >= 85 * len(s | t):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


@pytest.fixture(scope="module")
def found(docs):
    return O.linked(docs).collect()


def test_against_brute_force(found, corpus):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(corpus)


def test_one_of_each(docs, found, crowded, unharmed):
    kept = unharmed(O.one_of_each(crowded), crowded)
    ids = [r.doc_id for r in kept.collect()]
    heads = {r.component_id for r in found if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(heads)
    assert ids.count(None) == 2


def test_chain_of_neighbours(spark):
    # Each links to the next and not to the one after: one component, found across shingles that no star covers.
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[5 * k : 5 * k + 100])) for k in range(30)]
    got = O.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, c) for i, _, c in brute(rows)}
    assert len({c for _, _, c in brute(rows)}) == 1


@pytest.mark.parametrize("broadcast", [0, 250_000])
def test_hot_shingles_are_salted(spark, monkeypatch, broadcast):
    monkeypatch.setattr(O, "HOT", 3)
    monkeypatch.setattr(O, "CENTRE", 1)
    monkeypatch.setattr(O, "CROWD", 1)
    monkeypatch.setattr(O, "MAX_BROADCAST", broadcast)
    rows = [(i, "the same few words open " + " ".join(f"{'x' * (i % 5)}{k}" for k in range(i % 7 + 20))) for i in range(60)]
    got = O.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_empty(empty):
    assert O.linked(empty).count() == 0
    assert O.one_of_each(empty).count() == 0


@pytest.mark.parametrize("heavy", [0, 128])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(C, "HEAVY", heavy)
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)] + [(i, i + 1) for i in range(20, 60)] + [(1000, i) for i in range(100, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = defaultdict(int, {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)} | {i: 100 for i in [*range(100, 300), 1000]})
    assert got == dict(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
