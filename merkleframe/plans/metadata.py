"""Lookups, roots, snapshots, commits, pins and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from merkleframe.functions import identity as I
from merkleframe.operators import metadata as M
from merkleframe.operators.order import numbered
from merkleframe.plans.base import Plans
from merkleframe.session import table
from merkleframe.streaming.state import latest_state

P = Plans()
query = P.query
QUERIES, ORACLE = P.queries, P.oracle

#: Requested keys: each third part, one that isn't there after it, and every tenth twice.
SQL_KEYS = "(SELECT p_partkey * 3 AS p_partkey, p_partkey AS ordinal FROM part UNION ALL SELECT p_partkey * 3, p_partkey + 1000000 FROM part WHERE p_partkey % 10 = 0)"


def wanted_parts(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") * 3).alias("p_partkey"), F.col("p_partkey").alias("ordinal")).union(p.where("p_partkey % 10 = 0").select(F.col("p_partkey") * 3, F.col("p_partkey") + 1000000))


@query(f"SELECT ordinal, k.p_partkey, p_name, p_size FROM {SQL_KEYS} k LEFT JOIN part p USING (p_partkey)")
def object_batch_lookup(spark, d):
    return M.batch_lookup(wanted_parts(spark, d), table(spark, d, "part"), "p_partkey", ["p_name", "p_size"])


@query("SELECT ordinal, p_partkey, p_brand FROM (VALUES (0, 5::BIGINT), (1, -1), (2, 7), (3, 5)) v(ordinal, p_partkey) LEFT JOIN part USING (p_partkey)")
def batch_lookup_values(spark, d):
    keys = spark.createDataFrame([(0, 5), (1, -1), (2, 7), (3, 5)], "ordinal int, p_partkey long")
    return M.batch_lookup(F.broadcast(keys), table(spark, d, "part"), "p_partkey", ["p_brand"])


@query(f"SELECT ordinal, k.p_partkey, sha256(p_name) AS payload, length(p_name)::INT AS payload_size FROM {SQL_KEYS} k LEFT JOIN part p USING (p_partkey)")
def payload_batch(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("payload"), F.length("p_name").alias("payload_size"))
    return M.batch_lookup(wanted_parts(spark, d), p, "p_partkey", ["payload", "payload_size"])


SQL_ORDERS = "(SELECT o_orderkey * 2 AS o_orderkey, o_orderkey AS ordinal FROM orders)"


def wanted_orders(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.col("o_orderkey").alias("ordinal"))


@query(f"SELECT ordinal, k.o_orderkey, o_totalprice AS payload FROM {SQL_ORDERS} k LEFT JOIN orders o ON o.o_orderkey = k.o_orderkey AND o_orderstatus = 'F'")
def validated_payload_batch(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("payload"))
    return M.batch_lookup(wanted_orders(spark, d), o, "o_orderkey", ["payload"])


@query(f"SELECT ordinal, coalesce(o_orderstatus = 'F', false) AS validated FROM {SQL_ORDERS} k LEFT JOIN orders o USING (o_orderkey)")
def validated_flags_batch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("validated"))
    return M.batch_lookup(wanted_orders(spark, d), o, "o_orderkey", ["validated"]).select("ordinal", F.coalesce("validated", F.lit(False)).alias("validated"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def object_point_lookup(spark, d):
    return table(spark, d, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderkey, o_custkey FROM orders")
def unordered_object_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


@query("SELECT 'order/' || o_orderkey AS key, o_custkey, row_number() OVER (ORDER BY 'order/' || o_orderkey) - 1 AS rn FROM orders")
def ordered_object_scan(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("key"), "o_custkey")
    return numbered(o, ["key"], "rn")


@query("SELECT r_name, r_regionkey FROM region WHERE r_name = 'ASIA'")
def root_lookup(spark, d):
    return table(spark, d, "region").where("r_name = 'ASIA'").select("r_name", "r_regionkey")


@query("SELECT 'cust/' || c_custkey AS name, c_custkey AS target, row_number() OVER (ORDER BY 'cust/' || c_custkey) - 1 AS rn FROM customer")
def roots_ordered(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("cust/"), F.col("c_custkey")).alias("name"), F.col("c_custkey").alias("target"))
    return numbered(c, ["name"], "rn")


SQL_HOST = "split_part(url, '://', 2)"
PREFIX = "http://"


@query(f"SELECT url AS name FROM pages WHERE split_part({SQL_HOST}, '/', 2) = 'en' OR split_part(split_part({SQL_HOST}, '?', 1), '/', 2) = 'fr'")
def roots_under_prefix(spark, d):
    name = F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), r"^[^/]*/", "")
    p = table(spark, d, "pages").select(F.col("url"), name.alias("name"))
    return p.where(I.is_under(F.col("name"), F.lit("en")) | I.is_under(F.col("name"), F.lit("fr"))).select(F.col("url").alias("name"))


@query(f"SELECT url AS key, page_id AS value, (SELECT count(*) FROM pages WHERE starts_with(url, '{PREFIX}') AND url > '{PREFIX}b') > 40 AS has_more FROM pages WHERE starts_with(url, '{PREFIX}') AND url > '{PREFIX}b' ORDER BY url LIMIT 40")
def prefix_scan_page(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("key"), F.col("page_id").alias("value"))
    return M.prefix_page(p, "key", PREFIX, PREFIX + "b", 40)


@query("SELECT k.user_id, k.event_type, e.value FROM (SELECT DISTINCT user_id + 3 AS user_id, event_type FROM events) k LEFT JOIN (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL) e USING (user_id, event_type)")
def metadata_get(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    keys = e.select((F.col("user_id") + 3).alias("user_id"), "event_type").distinct()
    return keys.join(M.latest(e, ["user_id", "event_type"], ["event_id"]), ["user_id", "event_type"], "left").select("user_id", "event_type", "value")


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY ALL")
def as_of_snapshot(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    cut = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("cut"))
    now = M.latest(e, ["user_id", "event_type"], ["ts"], F.col("ts") <= cut.scalar())
    return now.select("user_id", "event_type", "event_id", "value")


@query("""WITH s AS (SELECT user_id, max(event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
c AS (SELECT event_id // 100 AS batch, event_id % 100 AS idx, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS expected FROM events WHERE event_id % 2 = 0)
SELECT batch, min(CASE WHEN c.expected IS DISTINCT FROM s.value THEN idx END) AS first_conflict FROM c LEFT JOIN s USING (user_id) GROUP BY batch""")
def commit_conflict_index(spark, d):
    e = table(spark, d, "events").where("event_id % 2 = 0")
    state = e.groupBy("user_id").agg(F.max("event_id").alias("value"))
    checks = e.select(F.floor(F.col("event_id") / 100).alias("batch"), (F.col("event_id") % 100).alias("index"), "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("expected"))
    return M.first_conflict(checks, state, "user_id")


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'insert' WHEN doc_id % 4 = 1 THEN 'conflict' ELSE 'noop' END AS outcome, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def immutable_insert_classify(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("payload"), "n_chars", "lang")
    held = docs.where("doc_id % 4 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 4 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return M.classify_inserts(docs, held, "doc_id", ["payload", "n_chars", "lang"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def immutable_conflicts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("payload"), "n_chars")
    held = docs.withColumn("n_chars", F.when(F.col("doc_id") % 4 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return M.classify_inserts(docs, held, "doc_id", ["payload", "n_chars"]).where("outcome = 'conflict'").select("doc_id")


@query("SELECT 'cust/' || c_custkey AS name, c_nationkey % 2 = 0 AS applied, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey END AS target FROM customer")
def cas_root_update(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("cust/"), F.col("c_custkey")).alias("name"), F.col("c_custkey").alias("target"), "c_nationkey")
    ask = c.select("name", F.when(F.col("c_nationkey") % 2 == 0, F.col("target")).alias("expected"), (F.col("target") + 1).alias("wanted"))
    ok = F.col("expected").eqNullSafe(F.col("target"))
    return c.join(ask, "name").select("name", ok.alias("applied"), F.when(ok, F.col("wanted")).otherwise(F.col("target")).alias("target"))


@query("""WITH b AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY 1), h AS (SELECT user_id, max(event_id) AS v FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
SELECT CASE WHEN h.v IS NULL THEN '-' ELSE '+' END AS op, user_id AS key FROM b FULL JOIN h USING (user_id) WHERE b.v IS DISTINCT FROM h.v""")
def catalog_delta(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id")
    newest = lambda x: x.groupBy("key").agg(F.max("event_id").alias("v"))
    return M.delta(newest(e.where("event_id % 2 = 0 AND key % 5 <> 0")), newest(e.where("key % 7 <> 0")), "key", "v")


SQL_PIN = "(SELECT user_id AS token, event_id, event_type FROM events)"
ENDS = ["purchase", "logout"]


@query("SELECT user_id AS token, CASE WHEN arg_max(event_type, event_id) IN ('purchase', 'logout') THEN 'closed' ELSE 'open' END AS state FROM events GROUP BY 1")
def pin_ledger_replay(spark, d):
    return M.replay(table(spark, d, "events").withColumnRenamed("user_id", "token"), "token", "event_id", "event_type", ENDS)


@query("SELECT c.event_id AS claim, count(*)::BIGINT AS conflicts, min(p.event_id) AS first_pin FROM events c JOIN events p ON c.user_id = p.user_id WHERE p.event_type = 'click' AND c.event_type = 'view' GROUP BY c.event_id")
def pin_conflicts(spark, d):
    """Each claim with the number of pins that it meets, and the first of them: a user's pins are summed up once, not paired."""
    e = table(spark, d, "events")
    claims = e.where("event_type = 'view'").select(F.col("event_id").alias("claim"), "user_id")
    pins = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("event_id").alias("conflicts"), F.min("event_id").alias("first_pin"))
    return claims.join(pins, "user_id").select("claim", "conflicts", "first_pin")


@query("SELECT user_id AS token, event_type AS scope, count(*)::BIGINT AS resources, min(event_id) AS generation FROM events GROUP BY ALL")
def pin_inventory(spark, d):
    pins = table(spark, d, "events").groupBy(F.col("user_id").alias("token"), F.col("event_type").alias("scope")).agg(F.count("event_id").alias("resources"), F.min("event_id").alias("generation"))
    return pins.select("token", "scope", "resources", "generation")


@query("SELECT event_type AS scope, count(DISTINCT user_id)::BIGINT AS holders, count(*)::BIGINT AS resources FROM events GROUP BY 1")
def holds_report(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("scope")).agg(F.countDistinct("user_id").alias("holders"), F.count("*").alias("resources"))


SQL_LRU = "(SELECT 'cust/' || c_custkey AS name, greatest(0, round(c_acctbal))::BIGINT AS bytes, last_use FROM customer JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_use FROM orders GROUP BY 1) USING (c_custkey) WHERE c_mktsegment = 'BUILDING')"


@query(f"""WITH r AS {SQL_LRU}, t AS (SELECT sum(bytes)::BIGINT AS used FROM r)
SELECT name, last_use, (sum(bytes) OVER w)::BIGINT AS cum_bytes, (used - (sum(bytes) OVER w - bytes)) * 100 >= 1000000 * 75 AS evict FROM r, t WINDOW w AS (ORDER BY last_use, name)""")
def evict_lru_order(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_use"))
    r = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").join(last, "c_custkey")
    r = r.select(F.concat(F.lit("cust/"), F.col("c_custkey")).alias("name"), F.greatest(F.lit(0), F.round("c_acctbal")).cast("long").alias("bytes"), "last_use")
    return M.eviction_order(r, "bytes", "last_use", "name", 1_000_000, 75).select("name", "last_use", "cum_bytes", "evict")


@query("SELECT user_id, event_type, min(event_id) AS ordinal FROM events GROUP BY ALL")
def first_occurrence_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("ordinal"))


@query("SELECT 'cust/' || c_custkey AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'evictable' ELSE 'permanent' END AS policy, CASE WHEN c_mktsegment = 'BUILDING' THEN last_use END AS last_use FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_use FROM orders GROUP BY 1) USING (c_custkey)")
def root_list_with_policy(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_use"))
    c = table(spark, d, "customer")
    policy = c.where("c_mktsegment = 'BUILDING'").join(last, "c_custkey", "left").select("c_custkey", F.lit("evictable").alias("policy"), "last_use")
    return c.select("c_custkey").join(policy, "c_custkey", "left").select(F.concat(F.lit("cust/"), F.col("c_custkey")).alias("name"), F.coalesce("policy", F.lit("permanent")).alias("policy"), "last_use")


@query("SELECT c_mktsegment AS policy, count(*)::BIGINT AS roots, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING')::BIGINT AS refreshed FROM customer GROUP BY 1")
def root_retention_policy(spark, d):
    # Setting a root refreshes its policy only where it has one.
    hit = (F.col("c_custkey") % 2 == 0) & (F.col("c_mktsegment") == "BUILDING")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("policy")).agg(F.count("*").alias("roots"), F.count(F.when(hit, 1)).alias("refreshed"))


SQL_DISK = "(SELECT s_suppkey, 100000::BIGINT AS total, (round(s_acctbal * 10))::BIGINT AS free FROM supplier)"


def disks(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.lit(100_000).cast("long").alias("total"), F.round(F.col("s_acctbal") * 10).cast("long").alias("free"))


@query(f"SELECT s_suppkey, greatest(total - free, 0) * 100 >= total * 80 AS pressed FROM {SQL_DISK}")
def disk_pressure(spark, d):
    return disks(spark, d).select("s_suppkey", I.used_percent_at_least(F.col("total"), F.col("free"), 80).alias("pressed"))


@query(f"SELECT CASE WHEN greatest(total - free, 0) * 100 >= total * 80 THEN 'collect' ELSE 'skip' END AS action, count(*)::BIGINT AS n FROM {SQL_DISK} GROUP BY 1")
def emergency_collection_gate(spark, d):
    gate = F.when(I.used_percent_at_least(F.col("total"), F.col("free"), 80), "collect").otherwise("skip")
    return disks(spark, d).groupBy(gate.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT url AS name FROM pages WHERE NOT starts_with(url, 'https://m.')")
def remove_roots_by_prefix(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("name"))
    return p.join(p.where(F.col("name").startswith("https://m.")), "name", "left_anti")


@query("SELECT count(*)::BIGINT AS staged, count(DISTINCT sha256(text))::BIGINT AS payloads, count(DISTINCT doc_id)::BIGINT AS objects FROM documents")
def stage_objects(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("payload"))
    return s.agg(F.count("*").alias("staged"), F.countDistinct("payload").alias("payloads"), F.countDistinct("doc_id").alias("objects"))


@query("SELECT event_id, (CASE WHEN (event_id + 1) % 2 = 1 THEN 0 ELSE length(bin(xor(event_id + 1, event_id))) - 1 END)::INT AS level FROM events")
def run_level_placement(spark, d):
    # Run n + 1 carries through as many levels as n + 1 has low zero bits.
    n = F.col("event_id") + 1
    carried = F.bit_count(n.bitwiseXOR(n - 1)) - 1
    return table(spark, d, "events").select("event_id", carried.alias("level"))


@query("SELECT event_id // 64 AS fragment, count(*)::BIGINT AS records FROM events WHERE event_id // 64 < (SELECT min(event_id) // 64 FROM events WHERE event_id % 1000 = 999) GROUP BY 1")
def wal_prunable_fragments(spark, d):
    e = table(spark, d, "events")
    pinned = e.where("event_id % 1000 = 999").agg(F.floor(F.min("event_id") / 64).alias("oldest"))
    f = e.groupBy(F.floor(F.col("event_id") / 64).alias("fragment")).agg(F.count("*").alias("records"))
    return f.where(F.col("fragment") < pinned.scalar()).select("fragment", "records")


@query("SELECT user_id AS key, bool_or(event_type = 'purchase') AS recursive, min(event_id) AS first FROM events GROUP BY 1")
def batch_recursion_upgrade(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.bool_or(F.col("event_type") == "purchase").alias("recursive"), F.min("event_id").alias("first"))


SQL_SYNC = "(SELECT doc_id, length(text)::BIGINT AS bytes, CASE WHEN doc_id % 3 = 0 THEN 'copy' WHEN doc_id % 3 = 1 AND doc_id % 5 = 0 THEN 'conflict' ELSE 'skip' END AS action FROM documents)"


def sync_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("payload"), F.length("text").cast("long").alias("bytes"))
    held = docs.where("doc_id % 3 <> 0").withColumn("payload", F.when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 5 == 0), F.reverse("payload")).otherwise(F.col("payload")))
    x = M.classify_inserts(docs, held, "doc_id", ["payload"])
    return x.withColumn("action", F.when(F.col("outcome") == "insert", "copy").when(F.col("outcome") == "noop", "skip").otherwise("conflict"))


@query(f"SELECT action, count(*)::BIGINT AS objects, sum(bytes)::BIGINT AS bytes FROM {SQL_SYNC} GROUP BY 1")
def sync_plan(spark, d):
    return sync_rows(spark, d).groupBy("action").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))


@query(f"""WITH held AS (SELECT DISTINCT sha256(text) AS p FROM documents WHERE doc_id % 3 <> 0), w AS (SELECT sha256(text) AS p, any_value(length(text)) AS bytes FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 = 0)::BIGINT AS published, count(*) FILTER (WHERE p NOT IN (SELECT p FROM held))::BIGINT AS payloads_sent, count(*) FILTER (WHERE p IN (SELECT p FROM held))::BIGINT AS payloads_reused,
coalesce(sum(bytes) FILTER (WHERE p NOT IN (SELECT p FROM held)), 0)::BIGINT AS bytes_sent FROM w""")
def sync_progress(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("p"), F.length("text").alias("bytes"))
    per = docs.groupBy("p").agg(F.count(F.when(F.col("doc_id") % 3 == 0, 1)).alias("wanted"), F.bool_or(F.col("doc_id") % 3 != 0).alias("held"), F.max("bytes").alias("bytes")).where("wanted > 0")
    sent = ~F.col("held")
    return per.agg(F.sum("wanted").alias("published"), F.count(F.when(sent, 1)).alias("payloads_sent"), F.count(F.when(F.col("held"), 1)).alias("payloads_reused"), F.sum(F.when(sent, F.col("bytes")).otherwise(0)).cast("long").alias("bytes_sent"))


@query("SELECT l_orderkey % 64 AS pack, l_partkey AS payload, l_orderkey AS key, row_number() OVER (ORDER BY l_orderkey % 64, l_partkey, l_orderkey) - 1 AS position FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def physical_scan_order(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("pack"), F.col("l_partkey").alias("payload"), F.col("l_orderkey").alias("key")).distinct()
    return numbered(x, ["pack", "payload", "key"], "position")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def event_state_stream(spark, d):
    return latest_state(spark, f"{d}/events.parquet", ["user_id", "event_type"], "event_id", ["value"])

