import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for with as on be at by this from or an are it was not have".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Plain, near-copied, copied, short, null and odd documents, one very long one, and ids, languages and sources that are null or repeat."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        rows.append((i, "\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 8))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None])))
    for i in range(120, 160):  # near copies of a few
        words = rows[i % 3][1].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "en", "a"))
    for i in range(160, 170):
        rows.append((i, rows[5][1], "en", "b"))
    rows += [(170, None, None, None), (171, "", "en", "a"), (172, "   \n\t ", "en", "a"), (173, "one", "en", "a"), (174, "ONE", "en", "a"), (175, "two words", "en", "c")]
    rows += [(176, " ".join(["word"] * 60), "en", "a"), (177, "é ü ñ 漢字 " * 30, "fr", "b"), (178, "#*$% " * 80 + "\n" + "x | y\n" * 10, "en", "a")]
    rows += [(179, "\n".join(sentence(rng, 30) for _ in range(700)), "en", "b")]  # long
    rows += [(7, rows[7][1], rows[7][2], rows[7][3]), (8, "another text under the same id " * 8, "en", "b"), (None, rows[9][1], "en", "a"), (None, "nobody's text " * 20, None, None)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The documents, with columns named as operators' own might be."""
    from pyspark.sql import functions as F

    for name in ("version", "n", "grp", "key", "pos", "line", "w", "size", "copies", "positions", "n_lines", "licence", "own", "_own", "row", "at", "lone", "spans", "hit_id", "gone_id", "dropped", "lines"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def unharmed():
    """Asserts that a frame made from the crowded one has its columns, and that the odd ones are as they were."""

    def check(df, crowded):
        assert df.columns == crowded.columns
        odd = crowded.columns[5:]
        assert {tuple(r) for r in df.select(*odd).distinct().collect()} == {("x",) * len(odd)}
        return df

    return check
