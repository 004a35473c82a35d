"""Reachability, collection and audit of the order graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merkleframe.operators import graph
from merkleframe.operators.order import numbered
from merkleframe.plans.base import SQL_CHUNKS, SQL_LINKS, SQL_OBJECTS, Plans, blobs, graph_links, graph_objects, lines
from merkleframe.session import table, written

P = Plans()
query = P.query
QUERIES, ORACLE = P.queries, P.oracle

REACH = f"""WITH RECURSIVE links AS ({SQL_LINKS}), objects AS ({SQL_OBJECTS}),
reach(key) AS ({{seeds}} UNION SELECT l.dst FROM reach r JOIN links l ON l.src = r.key)"""
ROOT_REGIONS = "SELECT 'region/' || r_regionkey FROM region WHERE r_name IN ('AFRICA', 'ASIA', 'MIDDLE EAST')"
EXPORT_ROOTS = "SELECT 'customer/' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


def _root_regions(spark, d) -> DataFrame:
    return table(spark, d, "region").where("r_name IN ('AFRICA', 'ASIA', 'MIDDLE EAST')").select(F.concat(F.lit("region/"), F.col("r_regionkey")).alias("key"))


def _customers(spark, d, where: str = "true") -> DataFrame:
    return table(spark, d, "customer").where(where).select(F.concat(F.lit("customer/"), F.col("c_custkey")).alias("key"))


def _exported(spark, d) -> DataFrame:
    return _customers(spark, d, "c_mktsegment = 'BUILDING'")


def _orders(spark, d, where: str = "true") -> DataFrame:
    return table(spark, d, "orders").where(where).select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("key"))


def _kept_parts(objects: DataFrame) -> DataFrame:
    """Objects without the parts whose number is divisible by 97, so that there are gaps."""
    number = F.split("key", "/")[1].cast("long")
    return objects.where((F.col("namespace") != "part") | (number % 97 != 0))


@query(f"""{REACH.format(seeds=ROOT_REGIONS)}
SELECT namespace, count(r.key)::BIGINT AS reachable, (count(*) - count(r.key))::BIGINT AS unreachable FROM objects o LEFT JOIN reach r USING (key) GROUP BY namespace""")
def reachable_closure_counts(spark, d):
    live = graph.reach(_root_regions(spark, d), graph_links(spark, d)).select("key", F.lit(1).alias("live"))
    o = graph_objects(spark, d).join(live, "key", "left")
    return o.groupBy("namespace").agg(F.count("live").alias("reachable"), (F.count("*") - F.count("live")).alias("unreachable"))


SQL_GAPS = f"""WITH RECURSIVE links AS ({SQL_LINKS}), objects AS (SELECT * FROM ({SQL_OBJECTS}) WHERE namespace <> 'part' OR split_part(key, '/', 2)::BIGINT % 97 <> 0),
seeds AS ({{seeds}}), reach(root, key) AS (SELECT key, key FROM seeds UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.key)"""
EACH_ORDER = "SELECT 'order/' || o_orderkey AS key FROM orders"


@query(f"""{SQL_GAPS.format(seeds=EACH_ORDER)}
SELECT root, CASE WHEN bool_or(o.key IS NULL AND r.key = r.root) THEN 'Missing' WHEN bool_or(o.key IS NULL) THEN 'Incomplete' ELSE 'Complete' END AS status,
       CASE WHEN bool_or(o.key IS NULL) THEN NULL ELSE count(*)::BIGINT END AS objects
FROM reach r LEFT JOIN objects o ON o.key = r.key GROUP BY root""")
def closure_verify_status(spark, d):
    return graph.closure_status(_orders(spark, d), graph_links(spark, d), _kept_parts(graph_objects(spark, d)))


@query(f"""{SQL_GAPS.format(seeds="SELECT 'customer/' || c_custkey AS key FROM customer")},
walk(root, from_key, key, path) AS (SELECT key, NULL::VARCHAR, key, [key] FROM seeds UNION ALL
  SELECT w.root, w.key, l.dst, list_append(w.path, l.dst) FROM walk w JOIN links l ON l.src = w.key JOIN objects o ON o.key = w.key),
gap AS (SELECT root, from_key, key, row_number() OVER (PARTITION BY root ORDER BY len(path), path) AS r FROM walk w WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.key = w.key))
SELECT root, from_key, key AS missing_key FROM gap WHERE r = 1""")
def closure_first_missing(spark, d):
    return graph.first_missing(_customers(spark, d), graph_links(spark, d), _kept_parts(graph_objects(spark, d)))


@query(f"""WITH RECURSIVE links AS ({SQL_LINKS}), objects AS ({SQL_OBJECTS}),
settled AS (SELECT 'order/' || o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'),
reach(key) AS ({ROOT_REGIONS} UNION SELECT l.dst FROM reach r JOIN links l ON l.src = r.key WHERE r.key NOT IN (SELECT key FROM settled))
SELECT namespace, count(*)::BIGINT AS visited FROM reach JOIN objects USING (key) GROUP BY namespace""")
def incremental_closure(spark, d):
    settled = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("key"))
    seen = graph.reach(_root_regions(spark, d), graph_links(spark, d), stop=settled)
    return seen.join(graph_objects(spark, d), "key").groupBy("namespace").agg(F.count("*").alias("visited"))


@query(f"""{REACH.format(seeds=EACH_ORDER.replace(" AS key", ""))} SELECT key FROM reach""")
def commit_closure_walk(spark, d):
    return graph.reach(_orders(spark, d), graph_links(spark, d)).select("key")


@query(f"""WITH x AS (SELECT 'order/' || o_orderkey AS root FROM orders), links AS ({SQL_LINKS}), p AS (SELECT 'part/' || p_partkey AS key, sha256(p_name) AS payload, octet_length(encode(p_name))::BIGINT AS size FROM part)
SELECT DISTINCT root, payload, size FROM x JOIN links ON src = root JOIN p ON key = dst""")
def closure_payloads(spark, d):
    c = graph.reach_from_each(_orders(spark, d), graph_links(spark, d))
    p = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("key"), F.sha2("p_name", 256).alias("payload"), F.octet_length("p_name").cast("long").alias("size"))
    return c.join(p, "key").select("root", "payload", "size").distinct()


@query(f"""{REACH.format(seeds="SELECT * FROM (" + EXPORT_ROOTS + ") UNION SELECT 'order/' || o_orderkey FROM orders WHERE o_orderstatus = 'P'")}
SELECT namespace, count(*)::BIGINT AS objects FROM reach JOIN objects USING (key) GROUP BY namespace""")
def closure_union(spark, d):
    more = _orders(spark, d, "o_orderstatus = 'P'")
    links = graph_links(spark, d)
    both = graph.reach(_exported(spark, d), links).select("key").union(graph.reach(more, links).select("key")).distinct()
    return both.join(graph_objects(spark, d), "key").groupBy("namespace").agg(F.count("*").alias("objects"))


SQL_LIVE_DOCS = "SELECT doc_id, sha256(text) AS blob_id, text FROM documents WHERE doc_id % 2 = 0"
SQL_PREVIEW = f"""WITH live AS ({SQL_LIVE_DOCS}), chunks AS ({SQL_CHUNKS}),
dead AS (SELECT count(*) FILTER (WHERE doc_id % 2 = 1)::BIGINT AS logical_objects FROM documents),
b AS (SELECT count(DISTINCT sha256(text))::BIGINT AS payload_blobs FROM documents WHERE sha256(text) NOT IN (SELECT blob_id FROM live)),
c AS (SELECT count(DISTINCT chunk_id)::BIGINT AS chunks FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE doc_id % 2 = 0))"""


@query(f"{SQL_PREVIEW} SELECT * FROM dead, b, c")
def gc_preview(spark, d):
    b, c = blobs(spark, d), lines(spark, d)
    live = F.col("doc_id") % 2 == 0
    dead_blobs = b.select("blob_id").distinct().join(b.where(live).select("blob_id"), "blob_id", "left_anti")
    dead_chunks = c.select("chunk_id").distinct().join(c.where(live).select("chunk_id"), "chunk_id", "left_anti")
    n = lambda df: df.agg(F.count("*").alias("n"))
    return n(b.where(~live)).select(F.col("n").alias("logical_objects"), n(dead_blobs).scalar().alias("payload_blobs"), n(dead_chunks).scalar().alias("chunks"))


@query(f"SELECT chunk_id, count(*)::BIGINT AS refs FROM ({SQL_CHUNKS}) WHERE doc_id % 2 = 0 GROUP BY chunk_id")
def gc_live_chunks(spark, d):
    return lines(spark, d).where("doc_id % 2 = 0").groupBy("chunk_id").agg(F.count("*").alias("refs"))


@query("""WITH m AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id) AS cut FROM events)
SELECT event_id AS object, CASE WHEN event_id <= cut THEN 'generation' ELSE 'pinned' END AS reason FROM events, m WHERE event_id <= cut OR user_id % 10 = 0""")
def gc_pin_scope_mark(spark, d):
    e = table(spark, d, "events")
    cut = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").cast("long").alias("cut"))
    old = F.col("event_id") <= cut.scalar()
    return e.where(old | (F.col("user_id") % 10 == 0)).select(F.col("event_id").alias("object"), F.when(old, "generation").otherwise("pinned").alias("reason"))


PACK = "l_orderkey % 64"


@query(f"""WITH e AS (SELECT {PACK} AS pack, l_quantity::BIGINT AS len, l_returnflag <> 'R' AND l_linestatus = 'F' AS live FROM lineitem),
p AS (SELECT pack, sum(CASE WHEN live THEN len ELSE 0 END)::BIGINT AS live_bytes, sum(len)::BIGINT AS total_bytes FROM e GROUP BY pack)
SELECT pack, live_bytes, total_bytes, (total_bytes - live_bytes) * 100.0::DOUBLE / total_bytes AS dead_percent,
       CASE WHEN live_bytes = 0 OR (total_bytes - live_bytes) * 100 >= total_bytes * 50 THEN 'rewrite' ELSE 'tombstone' END AS action FROM p""")
def pack_liveness(spark, d):
    live = (F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "F")
    size = F.col("l_quantity").cast("long")
    p = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("pack")).agg(F.sum(F.when(live, size).otherwise(0)).alias("live_bytes"), F.sum(size).alias("total_bytes"))
    dead = F.col("total_bytes") - F.col("live_bytes")
    action = F.when((F.col("live_bytes") == 0) | (dead * 100 >= F.col("total_bytes") * 50), "rewrite").otherwise("tombstone")
    return p.select("*", (dead * F.lit(100.0) / F.col("total_bytes")).alias("dead_percent"), action.alias("action"))


# An audit: roots are the customers divisible by 5; parts divisible by 97 have no record, and order/1 links to a part that never was;
# brand Brand#13 has no payload; orders of status P are of an unknown format; parts of size 7 don't match their digest.
SQL_FSCK = f"""WITH RECURSIVE links AS ({SQL_LINKS}), objects AS (SELECT * FROM ({SQL_OBJECTS}) WHERE namespace IN ('customer', 'order') OR (namespace = 'part' AND split_part(key, '/', 2)::BIGINT % 97 <> 0)),
roots AS (SELECT 'customer/' || c_custkey AS key FROM customer WHERE c_custkey % 5 = 0),
reach(key) AS (SELECT key FROM roots UNION SELECT l.dst FROM reach r JOIN links l ON l.src = r.key),
part_key AS (SELECT 'part/' || p_partkey AS key, p_brand, p_size FROM part),
bad AS (
  SELECT key, 'MissingPayload' AS kind FROM part_key JOIN objects USING (key) WHERE p_brand = 'Brand#13'
  UNION ALL SELECT key, 'InvalidObject' FROM part_key JOIN objects USING (key) WHERE p_brand <> 'Brand#13' AND p_size = 7
  UNION ALL SELECT 'order/' || o_orderkey, 'UnsupportedNamespace' FROM orders WHERE o_orderstatus = 'P'),
findings AS (
  SELECT CASE WHEN kind = 'UnsupportedNamespace' THEN 'Unchecked' WHEN r.key IS NOT NULL THEN 'Corrupt' ELSE 'Collectible' END AS disposition, kind, b.key AS object FROM bad b LEFT JOIN reach r ON r.key = b.key
  UNION ALL SELECT 'Corrupt', 'MissingRecord', key FROM reach WHERE key NOT IN (SELECT key FROM objects)
  UNION ALL SELECT DISTINCT 'Collectible', 'MissingRecord', dst FROM links WHERE src IN (SELECT key FROM objects) AND src NOT IN (SELECT key FROM reach) AND dst NOT IN (SELECT key FROM objects) AND dst NOT IN (SELECT key FROM reach)
  UNION ALL SELECT 'Collectible', 'UnrootedObject', key FROM objects WHERE key NOT IN (SELECT key FROM reach))"""


def _findings(spark, d):
    links, o = graph_links(spark, d), graph_objects(spark, d)
    o = _kept_parts(o.where(F.col("namespace").isin("customer", "order", "part"))).select("key")
    roots = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("customer/"), F.col("c_custkey")).alias("key"))
    live = graph.reach(roots, links).select("key")
    part = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("key"), "p_brand", "p_size").join(o, "key", "left_semi")
    kind = F.when(F.col("p_brand") == "Brand#13", "MissingPayload").when(F.col("p_size") == 7, "InvalidObject")
    bad = part.select("key", kind.alias("kind")).where("kind IS NOT NULL")
    rooted = bad.join(live.withColumn("rooted", F.lit(True)), "key", "left")
    out = rooted.select(F.when(F.col("rooted"), "Corrupt").otherwise("Collectible").alias("disposition"), "kind", F.col("key").alias("object"))
    add = lambda df, disposition, kind: out.union(df.select(F.lit(disposition), F.lit(kind), df.columns[0]))
    out = add(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order/"), F.col("o_orderkey"))), "Unchecked", "UnsupportedNamespace")
    out = add(live.join(o, "key", "left_anti"), "Corrupt", "MissingRecord")
    unrooted = o.join(live, "key", "left_anti")
    gone = links.join(unrooted, links["src"] == unrooted["key"], "left_semi").select(F.col("dst").alias("key")).distinct()
    out = add(gone.join(o, "key", "left_anti").join(live, "key", "left_anti"), "Collectible", "MissingRecord")
    return add(unrooted, "Collectible", "UnrootedObject"), o, live


@query(f"{SQL_FSCK} SELECT * FROM findings")
def fsck_findings(spark, d):
    return _findings(spark, d)[0]


@query(f"""{SQL_FSCK} SELECT (SELECT count(*) FROM objects)::BIGINT AS objects_checked, count(*) FILTER (WHERE disposition = 'Corrupt')::BIGINT AS corrupt, count(*) FILTER (WHERE disposition = 'Collectible')::BIGINT AS collectible,
count(*) FILTER (WHERE disposition = 'Unchecked')::BIGINT AS unchecked, count(*) FILTER (WHERE disposition = 'Corrupt') = 0 AS healthy, count(*) = 0 AS clean FROM findings""")
def fsck_summary(spark, d):
    found, o, _ = _findings(spark, d)
    n = o.agg(F.count("*").alias("objects_checked"))
    of = lambda x: F.count(F.when(F.col("disposition") == x, 1))
    s = found.agg(of("Corrupt").alias("corrupt"), of("Collectible").alias("collectible"), of("Unchecked").alias("unchecked"), F.count("*").alias("n"))
    return s.select(n.scalar().alias("objects_checked"), "corrupt", "collectible", "unchecked", (F.col("corrupt") == 0).alias("healthy"), (F.col("n") == 0).alias("clean"))


RETAINED = "o_orderkey % 3 = 0"


@query("SELECT o_orderkey * 2 AS key FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)")
def retained_unknown_keys(spark, d):
    o = table(spark, d, "orders")
    wanted = o.where(RETAINED).select((F.col("o_orderkey") * 2).alias("key"))
    return wanted.join(o.select(F.col("o_orderkey").alias("key")), "key", "left_anti")


@query("SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def roots_not_retained(spark, d):
    kept = table(spark, d, "orders").where(RETAINED).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(kept, "c_custkey", "left_anti").select(F.col("c_name").alias("name"))


@query("SELECT l_orderkey AS src, l_partkey AS dst, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL")
def retained_link_expand(spark, d):
    kept = table(spark, d, "orders").where(RETAINED).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(kept, "l_orderkey").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 3 = 0 AND l_partkey % 4 = 0")
def links_outside_retained(spark, d):
    parts = table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    links = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select("l_orderkey", "l_partkey").distinct()
    return links.join(parts, "l_partkey", "left_anti").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def prune_unretained(spark, d):
    o = table(spark, d, "orders")
    return o.join(o.where(RETAINED).select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def validated_named_targets(spark, d):
    named = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(named, "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT 'unknown' AS guard, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'omitted root', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT 'omitted target', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_partkey % 4 = 0)""")
def retained_install_guards(spark, d):
    guards = (("unknown", retained_unknown_keys), ("omitted root", roots_not_retained), ("omitted target", links_outside_retained))
    out = None
    for name, f in guards:
        x = f(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("guard"), "n")
        out = x if out is None else out.union(x)
    return out


@query(f"""{SQL_GAPS.format(seeds=EACH_ORDER)} SELECT o_orderkey AS target, NOT EXISTS (SELECT 1 FROM reach r WHERE r.root = 'order/' || o_orderkey AND r.key NOT IN (SELECT key FROM objects)) AS complete FROM orders""")
def root_target_complete(spark, d):
    s = closure_verify_status(spark, d)
    return s.select(F.split("root", "/")[1].cast("long").alias("target"), (F.col("status") == "Complete").alias("complete"))


@query("SELECT l_partkey AS page FROM lineitem GROUP BY l_partkey HAVING bool_and(l_orderkey % 7 <> 0)")
def page_tree_gc(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("page"))
    marked = li.where("src % 7 = 0").select("page")
    return li.select("page").distinct().join(marked, "page", "left_anti")


@query("SELECT DISTINCT user_id AS catalog FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 20 = 0)")
def catalog_object_gc(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("catalog")).distinct().join(e.where("event_type = 'purchase' AND event_id % 20 = 0").select(F.col("user_id").alias("catalog")), "catalog", "left_anti")


@query("SELECT DISTINCT sha256(text) AS identity FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def prune_associations(spark, d):
    b = blobs(spark, d).select("doc_id", F.col("blob_id").alias("identity"))
    return b.select("identity").distinct().join(b.where("doc_id % 2 = 0"), "identity", "left_semi")


@query(f"""{REACH.format(seeds=EXPORT_ROOTS)},
payload AS (SELECT key, sha256(coalesce(p_brand, key)) AS payload FROM reach LEFT JOIN (SELECT 'part/' || p_partkey AS key, p_brand FROM part) USING (key)),
frames AS (SELECT 1 AS section, payload AS id FROM payload GROUP BY payload UNION ALL SELECT 2, key FROM payload)
SELECT section, id, row_number() OVER (ORDER BY section, id)::BIGINT AS frame FROM frames""")
def export_plan(spark, d):
    live = written(graph.reach(_exported(spark, d), graph_links(spark, d)).select("key"))
    part = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("key"), "p_brand")
    p = live.join(part, "key", "left").select("key", F.sha2(F.coalesce("p_brand", "key"), 256).alias("payload"))
    frames = p.select(F.lit(1).alias("section"), F.col("payload").alias("id")).distinct().union(p.select(F.lit(2), "key"))
    return numbered(frames, ["section", "id"], "frame", 1)


@query(f"""{REACH.format(seeds=EXPORT_ROOTS)}, held AS (SELECT key FROM objects WHERE split_part(key, '/', 2)::BIGINT % 11 <> 0 AND (key IN (SELECT key FROM reach) OR key LIKE 'order/%99'))
SELECT 'missing' AS side, key FROM reach WHERE key NOT IN (SELECT key FROM held) UNION ALL SELECT 'extra', key FROM held WHERE key NOT IN (SELECT key FROM reach)""")
def archive_membership_check(spark, d):
    live = written(graph.reach(_exported(spark, d), graph_links(spark, d)).select("key"))
    number = F.split("key", "/")[1].cast("long")
    o = graph_objects(spark, d).where(number % 11 != 0)
    held = o.join(live, "key", "left_semi").union(o.where(F.col("key").like("order/%99")).join(live, "key", "left_anti")).select("key")
    return live.join(held, "key", "left_anti").select(F.lit("missing").alias("side"), "key").union(held.join(live, "key", "left_anti").select(F.lit("extra"), "key"))


@query(f"""WITH RECURSIVE links AS ({SQL_LINKS}), seeds AS (SELECT 'nation/' || n_nationkey AS key FROM nation),
settled AS (SELECT 'order/' || o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'),
a(key) AS (SELECT key FROM seeds UNION SELECT l.dst FROM a r JOIN links l ON l.src = r.key),
b(key) AS (SELECT key FROM seeds UNION SELECT l.dst FROM b r JOIN links l ON l.src = r.key WHERE r.key NOT IN (SELECT key FROM settled))
SELECT 'Exhaustive' AS policy, count(*)::BIGINT AS visited FROM a UNION ALL SELECT 'ReuseVerified', count(*) FROM b""")
def sync_reuse_verified(spark, d):
    seeds = table(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("key"))
    settled = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("key"))
    links = graph_links(spark, d)
    n = lambda policy, df: df.agg(F.count("*").alias("visited")).select(F.lit(policy).alias("policy"), "visited")
    return n("Exhaustive", graph.reach(seeds, links)).union(n("ReuseVerified", graph.reach(seeds, links, stop=settled)))


@query(f"""SELECT 'order/' || o_orderkey AS key, o_orderstatus AS status, count(DISTINCT l_partkey)::BIGINT AS links FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def object_show(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return o.join(li, "o_orderkey", "left").groupBy(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").alias("status")).agg(F.countDistinct("l_partkey").alias("links"))


@query("SELECT o_orderkey AS dir, count(l_orderkey)::BIGINT AS size FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey UNION ALL SELECT -c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) FROM customer")
def directory_recursive_size(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders")
    o = o.join(e, o["o_orderkey"] == e["l_orderkey"], "left").select("o_custkey", F.col("o_orderkey").alias("dir"), F.coalesce("n", F.lit(0)).alias("size"))
    up = o.groupBy("o_custkey").agg(F.sum(F.col("size") + 1).alias("size"))
    c = table(spark, d, "customer")
    c = c.join(up, c["c_custkey"] == up["o_custkey"], "left").select((-F.col("c_custkey")).alias("dir"), F.coalesce("size", F.lit(0)).alias("size"))
    return o.select("dir", "size").union(c)
