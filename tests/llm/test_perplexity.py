import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from merkleframe.llm import op8_perplexity as O


def symbols(text):
    return list(text.encode())


def brute(trusted, text):
    """Mean negative log likelihood by the textbook's recursion."""
    top = Counter()
    for t in trusted:
        s = [0] * (O.ORDER - 1) + symbols(t)
        top.update(tuple(s[i : i + O.ORDER]) for i in range(len(s) - O.ORDER + 1))
    counts = {O.ORDER: top}
    for k in range(O.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, context = {}, {}
    for k, c in counts.items():
        n = [max(1, sum(v == i for v in c.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)]
        discount[k] = d
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            context[k][g[:-1]][0] += v
            context[k][g[:-1]][1] += d[min(v, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        low = p(g[1:])
        if g[:-1] not in context[k]:
            return low
        total, cut = context[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (v - (discount[k][min(v, 3) - 1] if v else 0)) / total + cut / total * low

    s = [0] * (O.ORDER - 1) + symbols(text)
    return -sum(math.log(p(tuple(s[i : i + O.ORDER]))) for i in range(len(s) - O.ORDER + 1)) / len(text.encode())


def test_against_brute_force(spark, docs, corpus):
    ids = [r[0] for r in corpus[:30]]
    trusted = [r[1] for r in corpus if r[0] in ids]
    got = O.scored(docs, spark.createDataFrame([(i,) for i in [*ids, None, ids[0]]], "doc_id long")).collect()
    assert len(got) == len(corpus)
    wanted = {(r[0], r[1]): r for r in corpus}
    checked = 0
    for r in got:
        texts = [t for i, t in wanted if i == r.doc_id and len((t or "").encode()) == r.n_symbols]
        if r.nll is None:
            assert texts and not texts[0]
        elif r.n_symbols < 2000 and r.doc_id is not None and len(texts) == 1:
            assert math.isclose(r.nll, brute_cached(trusted, texts[0]), rel_tol=1e-4)
            checked += 1
    assert checked > 50


_MEMO: dict = {}


def brute_cached(trusted, text):
    return _MEMO.setdefault(text, brute(trusted, text)) if text not in _MEMO else _MEMO[text]


@pytest.mark.parametrize("trust", [True, False])
def test_verdicts(spark, docs, corpus, trust):
    ids = spark.createDataFrame([(i,) for i in range(120)] if trust else [], "doc_id long")
    got = O.judged(docs, ids).collect()
    assert len(got) == len(corpus)
    if trust:
        assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 170)
        assert [r.kept for r in got if r.doc_id == 178] == [False]
    else:
        assert all(r.kept for r in got)
    assert all(r.kept and r.perplexity is None for r in got if not r.n_symbols)


def test_empty(spark, empty):
    assert O.judged(empty, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_scripts_beyond_ascii_are_judged_by_their_letters(spark):
    rng = random.Random(11)
    for words in ("и в не на что это как по но из года время было человек работа страна город дом".split(), "的 是 我们 在 有 他们 这个 中国 时间 工作 城市 人民 今天 学习".split()):
        letters = sorted(set("".join(words)))
        good = [(i, " ".join(rng.choice(words) for _ in range(200)), "x") for i in range(150)]
        bad = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in w) for w in t.split()), "x") for i, t, _ in good[:20]]
        docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
        got = O.judged(docs, spark.createDataFrame([(i,) for i in range(120)], "doc_id long")).collect()
        assert {r.doc_id for r in got if r.kept} == {r[0] for r in good}


def test_too_likely_text_goes(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    good = [(i, " ".join(rng.choice(words) for _ in range(600)), "en") for i in range(150)]
    docs = spark.createDataFrame([*good, (900, " ".join([min(words, key=len)] * 600), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in O.judged(docs, spark.createDataFrame([(i,) for i in range(120)], "doc_id long")).collect()}
    assert all(got[r[0]].kept for r in good) and not got[900].kept


def test_limits_are_quantiles(spark):
    rng = random.Random(13)
    rows = [(lang, 4 + rng.gauss(0, 0.3), rng.randint(100, 9000)) for lang, n in (("a", 1500), ("b", 40), (None, 30)) for _ in range(n)]
    got = {r.lang: r for r in O._limits(spark.createDataFrame(rows, "lang string, nll double, n_symbols long")).collect()}
    for lang in ("a", "b", None):
        high = sorted(math.floor((x - O.EVIDENCE["high"] / math.sqrt(n)) * O.GRID) for k, x, n in rows if lang in (None, k))
        low = sorted(math.floor((x + O.EVIDENCE["low"] / math.sqrt(n)) * O.GRID) for k, x, n in rows if lang in (None, k))
        n = len(high)
        assert got[lang]["all"] == n
        assert math.isclose(got[lang].high, (high[math.ceil(O.QUANTILE * n) - 1] + 1) / O.GRID + O.MARGIN)
        assert math.isclose(got[lang].low, low[math.floor((1 - O.QUANTILE) * n)] / O.GRID - O.MARGIN)


def test_frames_that_are_split_otherwise_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(O, "_table", lambda uri: (np.array([1], np.int64), np.array([1.0], np.float32)))
    with pytest.raises(Exception, match="split otherwise"):
        O.scored(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()


def test_clashing_columns_and_text_ids(spark, crowded, docs):
    assert O.judged(crowded, spark.createDataFrame([(1,)], "doc_id long")).count() == crowded.count()
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "lang")
    got = O.judged(named, spark.createDataFrame([(f"d{i}",) for i in range(30)], "doc_id string")).collect()
    assert sum(r.trusted for r in got) == 32 and {r.doc_id for r in got if r.doc_id} == {f"d{i}" for i in range(180)}
