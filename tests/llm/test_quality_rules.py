import random
import re
from collections import Counter

import numpy as np
import pytest

from merkleframe.llm import op3_quality_rules as O


def counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_brute_force(docs, corpus):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in O.judged(docs).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *counts(r[1])) for r in corpus), key=str)


def test_base_rules(docs):
    for r in O.judged(docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept in (True, False) and not (r.base_failed and r.kept)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 300))]
        if i % 30 == 0:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", "a" if i % 3 else "b"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_others_stay(mixed):
    for r in O.judged(mixed).collect():
        assert r.kept == (r.doc_id % 30 != 0), (r.doc_id, r.distance)
    assert O.keep_good(mixed).count() == 870


def test_estimate_is_that_of_the_core(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, O.DIMS)) * [0.5, 1, 2, 1] + [1, 2, 3, 4]
    x[:200] += 50
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(O.DIMS)))
    mean = O.estimates(df).first()["mean"]
    assert np.allclose(mean, [1, 2, 3, 4], atol=0.15)


def test_small_and_empty(spark, empty, crowded, unharmed):
    few = spark.createDataFrame([(1, "word " * 20 + " ".join(f"w{i}" for i in range(80)), None, None), (2, None, "en", None)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.kept, r.distance) for r in O.judged(few).collect()}
    assert got == {1: (True, None), 2: (False, None)}
    assert O.judged(empty).count() == 0 and O.keep_good(empty).count() == 0
    unharmed(O.keep_good(crowded), crowded)


def prose(rng, symbols=False):
    w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 300))]
    return " ".join(x + "###" if symbols else x for x in w)


@pytest.mark.parametrize("large", [0, 600])
def test_small_groups_fall_back(spark, large):
    # Beside a large group or alone: sources of few rows of one language, and rare languages, each with an outlier of its own.
    rng = random.Random(2)
    groups = [("en", "a")] * large + [("en", f"few{i % 3}") for i in range(60)] + [("fr", "b")] * 20 + [(None, None)] * 20 + [("en", None)] * 20
    outliers = [("en", "few0"), ("fr", "b"), (None, None), ("en", None)]
    rows = [(i, prose(rng), *g) for i, g in enumerate(groups)] + [(-1 - i, prose(rng, True), *g) for i, g in enumerate(outliers)]
    got = O.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.distance is not None and r.kept == (r.doc_id >= 0), (r.doc_id, r.distance)


def test_least_rows_of_an_estimate(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng), "en", "a") for i in range(O.LEAST)]
    schema = "doc_id long, text string, lang string, source string"
    assert all(r.distance is not None for r in O.judged(spark.createDataFrame(rows, schema)).collect())
    assert all(r.distance is None and r.kept for r in O.judged(spark.createDataFrame(rows[1:], schema)).collect())
