import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from merkleframe.llm import op9_language_id as O
from merkleframe.llm.tokens import load_vocabulary

TEXTS = {
    "en": "the cat and the dog were sitting on the mat with their friends when it was raining in the town",
    "de": "der Hund und die Katze waren nicht auf der Straße, weil es gestern in der Stadt sehr geregnet hatte",
    "fr": "le chien et le chat étaient assis sur le tapis avec leurs amis quand il pleuvait dans la ville",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(lang, text) for lang, text in TEXTS.items() for _ in range(5)] + [(None, "no language"), ("en", None)]
    return O.train(spark.createDataFrame(rows, "lang string, text string"))


def forward(word, logs, ranks):
    """Log of the sum over all segmentations, position by position."""
    alpha = [0.0]
    for t in range(1, len(word) + 1):
        x = [alpha[t - n] + logs[r] for n in range(1, t + 1) if (r := ranks.get(word[t - n : t])) is not None]
        alpha.append(max(x) + math.log(sum(math.exp(v - max(x)) for v in x)))
    return alpha[-1]


LONG = ["a" * 500, "漢字かな交じり文は空白を持たない" * 12, "https://example.com/" + "path-" * 40, " ".join(["=" * 300, "short"]), "Ã" * 100]


@pytest.mark.parametrize("unit", [1, 7, 48, 4096])
@pytest.mark.parametrize("chunk", [1, 300, 1 << 19])
def test_scores_sum_all_segmentations(model, monkeypatch, unit, chunk):
    """Of words shorter and longer than a unit, without a difference: pieces cross units."""
    monkeypatch.setattr(O, "UNIT", unit)
    monkeypatch.setattr(O, "CHUNK", chunk)
    ranks = load_vocabulary()
    texts = ["the Straße  was\nquand it rained xqzzy", *LONG, ""]
    data = [t.encode() for t in texts]
    got = model.scores(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    for row, d in zip(got, data, strict=True):
        for k in range(len(model.langs)):
            key = d, k
            if key not in MEMO:
                MEMO[key] = sum(forward(b" " + w, model.logs[:, k], ranks) for w in d.split())
            assert math.isclose(row[k], MEMO[key], rel_tol=1e-9, abs_tol=1e-9)


MEMO: dict = {}


def test_pieces_of_any_length_count():
    ranks = load_vocabulary()
    longest = max(ranks, key=len)
    assert len(longest) > 64
    model = O.Model(["x"], np.log(np.full((len(ranks), 1), 1e-3)), O._index(ranks))
    buf = np.frombuffer(longest, np.uint8)
    assert math.isclose(model.word_scores(buf, np.array([len(buf)]))[0, 0], forward(longest, model.logs[:, 0], ranks), rel_tol=1e-9)


def test_predictions(spark, model):
    rows = [(i, t) for i, t in enumerate(TEXTS.values())] + [(10, None), (11, ""), (12, "12 34 !?"), (13, "le chat était dans la ville " * 3000), (13, "der Hund"), (None, "the dog and the cat")]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in O.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()), key=str)
    assert {(i, p) for i, p, _ in got} == {(0, "en"), (1, "de"), (2, "fr"), (10, "und"), (11, "und"), (12, "und"), (13, "fr"), (13, "de"), (None, "en")}
    assert all(0 <= s <= 1 for *_, s in got) and {s for _, p, s in got if p == "und"} == {0.0}


def test_nothing_learned(spark, docs, empty):
    model = O.train(empty)
    assert {(r.lang_pred, r.score) for r in O.predict(docs, model).collect()} == {("und", 0.0)}
    assert O.predict(empty, model).count() == 0


def test_held_out_accuracy(spark):
    got = O.op9_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out").agg(F.count("*"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1))).first()
    assert n > 20 and right >= 0.97 * n
