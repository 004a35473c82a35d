"""What the plan modules share: a registry decorator and projections of the tables onto the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merkleframe.session import table


class Plans:
    """Queries and their oracle SQL, by name."""

    def __init__(self):
        self.queries, self.oracle = {}, {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def blobs(spark, d: str) -> DataFrame:
    """(doc_id, blob_id, size, text, source) of each document's text as a blob."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("blob_id"), F.octet_length("text").cast("long").alias("size"), "text", "source")


def lines(spark, d: str) -> DataFrame:
    """(doc_id, source, ordinal, chunk, chunk_id, size): documents in chunks of one line."""
    x = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "chunk"))
    return x.select("*", F.sha2("chunk", 256).alias("chunk_id"), F.octet_length("chunk").cast("long").alias("size"))


#: The same for the oracle.
SQL_LINES = """SELECT doc_id, source, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS ordinal, unnest(string_split(text, chr(10))) AS chunk FROM documents"""
SQL_CHUNKS = f"""SELECT *, sha256(chunk) AS chunk_id, octet_length(encode(chunk))::BIGINT AS size FROM ({SQL_LINES})"""


def graph_links(spark, d: str) -> DataFrame:
    """(src, dst) of region -> nation -> customer -> order -> part; keys are texts of kind and number."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    n, c, o, li = (table(spark, d, x) for x in ("nation", "customer", "orders", "lineitem"))
    return (
        n.select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst"))
        .union(c.select(key("nation", "c_nationkey"), key("customer", "c_custkey")))
        .union(o.select(key("customer", "o_custkey"), key("order", "o_orderkey")))
        .union(li.select(key("order", "l_orderkey"), key("part", "l_partkey")).distinct())
    )


def graph_objects(spark, d: str) -> DataFrame:
    """(key, namespace) of every object of the graph."""
    out = None
    for name, kind, c in (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("orders", "order", "o_orderkey"), ("part", "part", "p_partkey")):
        x = table(spark, d, name).select(F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")).alias("key"), F.lit(kind).alias("namespace"))
        out = x if out is None else out.union(x)
    return out


SQL_LINKS = """SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders
UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem"""
SQL_OBJECTS = """SELECT 'region/' || r_regionkey AS key, 'region' AS namespace FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation' FROM nation
UNION ALL SELECT 'customer/' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'order/' || o_orderkey, 'order' FROM orders
UNION ALL SELECT 'part/' || p_partkey, 'part' FROM part"""
