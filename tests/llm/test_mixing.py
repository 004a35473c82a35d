import math
from collections import defaultdict

import pytest

from merkleframe.llm import op10_mixing as O


def fill(sizes):
    """Targets by taking away, again and again, sources that are above their limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: O.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, out = O.SHARE * sum(sizes.values()), {}
    while rest := [s for s in names if s not in out]:
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level >= O.MAX_PASSES * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in rest}
        for s in over:
            out[s] = float(O.MAX_PASSES * sizes[s])
            left -= out[s]
    return out


@pytest.fixture(scope="module")
def got(docs):
    return O.assign(docs).collect()


def test_targets(got, corpus):
    sizes = defaultdict(int)
    for i, text, _, source, _ in corpus:
        sizes[source] += len((text or "").split())
    want = fill(sizes)
    assert len(got) == len(corpus)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])


def test_taken_words_come_near_their_target(got):
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= O.MAX_PASSES == 2 and len(r.positions) == r.copies
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for r in got:
        assert abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1


def test_reruns_agree(docs, got):
    again = O.assign(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_positions_follow_the_schedule(got):
    """By numerical integration: what a source's rate has demanded by a document's position is what lies before it."""
    for place, source in enumerate(["a", "b", "c", None]):
        tilt = O.TILTS[place % 3]
        rows = [r for r in got if r.source == source]
        target = max(rows[0].target, 1)
        for r in rows:
            for j, p in enumerate(r.positions):
                steps = 2000
                rate = [1 - tilt / 2 + tilt * (k + 0.5) / steps for k in range(int(p * steps))]
                demand = sum(rate) / steps + (p - len(rate) / steps) * (1 - tilt / 2 + tilt * p)
                assert 0 <= p <= 1 and abs(demand * target - (j * r.source_size + r.before)) <= max(1.0, 1e-3 * target)
        # What is before a position is what was taken before it: one document's difference at most.
        taken, largest = 0, max(r.size for r in rows)
        for p, size, before in sorted((p, r.size, j * r.source_size + r.before) for r in rows for j, p in enumerate(r.positions)):
            assert abs(before - taken) <= largest
            taken += size


def test_curriculum_deals_copies_by_place_and_shuffles_texts_once_by_key(spark):
    # Rows that repeat an id, a source and a size, with texts of their own or alike, or without an id.
    rows = [(i % 7 if i % 5 else None, " ".join(f"w{(i * j) % 3}" for j in range(1 + i % 4)), "ab"[i % 2]) for i in range(120)]
    rows += [(1, "same text here", "a")] * 9 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places, alike = defaultdict(list), defaultdict(list)
    for r in O.assign(df).collect():
        places[r.doc_id, r.source, r.size].append((r.before, r.positions))
    for i, text, source in rows:
        alike[i, source, len((text or "").split())].append((text or "", i, text, source))
    want = []
    for k, own in alike.items():
        for (_, positions), (_, *row) in zip(sorted(places[k]), sorted(own, key=lambda x: x[0]), strict=True):
            want += [(p, tuple(row)) for p in positions]
    out = O.curriculum(df)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str(row) for _, row in want)
    above = out._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert above.count("Exchange") == 2 and "Join" not in above  # by key, and by range


def test_curriculum(docs, crowded, got, unharmed):
    out = unharmed(O.curriculum(crowded), crowded)
    rows = out.collect()
    assert len(rows) == sum(r.copies for r in got)
    assert sum(len((r.text or "").split()) for r in rows) == sum(r.copies * r.size for r in got)


def test_training_order(spark):
    out = O.op10_mixing(spark, "/root/testdata/sf0.001")
    rows = [(r.position_1 is not None, r.position_1 or 0.0, r.doc_id) for part in out.rdd.glom().collect() for r in part]
    assert rows == sorted(rows) and sum(r[0] for r in rows) > 100
    assert "SQRT" in out._jdf.queryExecution().toString()


def test_empty(spark, empty):
    assert O.assign(empty).count() == 0 and O.curriculum(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target) for r in O.assign(blank).collect()} == {(1, 0.0), (2, 0.0)}
