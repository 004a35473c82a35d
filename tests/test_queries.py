"""Every registered query that SQL can express, against its SQL in another engine."""

import random

import duckdb
import pytest

from merkleframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else repr(float(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {registry.oracle_sql()[name]}").fetchall()}
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == types
    r = con.execute(registry.oracle_sql()[name])
    theirs = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(theirs)
    order = sorted(theirs)
    want = sorted(tuple(plain(row[theirs.index(c)]) for c in order) for row in r.fetchall())
    got = sorted(tuple(plain(row[c]) for c in order) for row in df.collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_sql(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0


def test_no_oracle_row_is_vacuous(con):
    for name, sql in registry.oracle_sql().items():
        assert con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0] > 0, name


def test_needles_in_blocks(spark):
    from merkleframe.operators.storage import needle_hits

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    needles = [t[a : a + 12] for t in texts[:20] if t for a in (0, 3)] + ["never there", "", None, "ab", "ab"]
    df = spark.createDataFrame([(t,) for t in needles], "needle string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {n: sum(n in t for t in texts if t) if n else 0 for n in set(needles) - {None}}
    for block in (3, 1000):
        assert {r.needle: r.hits for r in needle_hits(docs, df, block).collect() if r.needle is not None} == want


def test_comparisons_have_every_outcome(con):
    got = con.execute(registry.oracle_sql()["bench_compare"]).fetchall()
    assert {r[1] for r in got} == {"base only", "head only", "skipped", "unchanged", "increased", "decreased"}
