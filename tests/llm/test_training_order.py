from collections import Counter

import numpy as np
import pytest

from merkleframe.llm import op4_training_order as O
from merkleframe.llm.tokens import load_vocabulary
from merkleframe.session import scratch, written


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    f = O.Feistel(n, 1)
    slots = f.slots(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.numbers(slots) == np.arange(n)).all()
    assert n < 64 or (slots != O.Feistel(n, 2).slots(np.arange(n))).any()


@pytest.fixture(scope="module")
def stored(docs):
    return written(docs.select("doc_id", "text"))


@pytest.mark.parametrize("shards", [None, 1, 7])
def test_round_trip(spark, stored, corpus, shards):
    files = O.write_shards(stored, scratch(spark), length=64, shards=shards)
    read = O.read_shards(files, length=64, block=1000)
    assert read.rdd.getNumPartitions() == files.count() == (shards or files.count())
    rows = read.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {len(r.tokens) for r in rows} == {128}
    # Back in the order of the numbers, the tokens are the documents.
    s, places = O.sequences(stored, length=64)
    by_place = sorted((r.place, bytes(r.tokens)) for r in s.collect())
    assert [bytes(r.tokens) for r in sorted(rows, key=lambda r: r.slot)] == [t for _, t in by_place]
    numbers = O.Feistel(places, O.SEED).numbers(np.array([p for p, _ in by_place]))
    stream = np.frombuffer(b"".join(by_place[i][1] for i in np.argsort(numbers)), "<u2")
    ranks = load_vocabulary()
    texts, now = Counter(), []
    for t in stream.tolist():
        if t != len(ranks):
            now.append(t)
        elif now:
            texts[b"".join(PIECES[x] for x in now).decode()] += 1
            now = []
    assert texts == Counter(r[1] for r in corpus if r[1])


PIECES = {r: p for p, r in load_vocabulary().items()}


def test_reruns_and_resumed_reads(spark, stored):
    a, b = (O.read_shards(O.write_shards(stored, scratch(spark), length=64, shards=5), length=64).collect() for _ in range(2))
    assert sorted((r.slot, bytes(r.tokens)) for r in a) == sorted((r.slot, bytes(r.tokens)) for r in b)
    files = O.write_shards(stored, scratch(spark), length=64, shards=5)
    later = O.read_shards(files, from_slot=len(a) // 2, length=64).collect()
    assert sorted((r.slot, bytes(r.tokens)) for r in later) == sorted((r.slot, bytes(r.tokens)) for r in a if r.slot >= len(a) // 2)


def test_nothing(spark, empty):
    assert O.read_shards(O.write_shards(written(empty), scratch(spark))).count() == 0
    none = written(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert O.read_shards(O.write_shards(none, scratch(spark))).count() == 0
