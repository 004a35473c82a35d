"""Directories, paths, names, deltas and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from merkleframe.functions import identity as I
from merkleframe.operators import graph, trees as T
from merkleframe.operators.order import numbered
from merkleframe.plans.base import Plans
from merkleframe.session import table
from merkleframe.sources.importers import build_tree

P = Plans()
query = P.query
QUERIES, ORACLE = P.queries, P.oracle

SQL_PARTS = "list_filter(string_split(regexp_replace(split_part(url, '://', 2), '[?#].*$', ''), '/'), lambda s: s <> '')"
SQL_ENTRIES = f"""(SELECT dir, name, child, CASE WHEN min(file) = 1 THEN 'file' ELSE 'directory' END AS kind FROM (
SELECT array_to_string(p[1:i], '/') AS dir, p[i + 1] AS name, array_to_string(p[1:i + 1], '/') AS child, CASE WHEN i = len(p) - 1 THEN 1 ELSE 0 END AS file FROM (SELECT p, unnest(range(0, len(p))) AS i FROM (SELECT {SQL_PARTS} AS p FROM pages))) GROUP BY ALL)"""


def entries(spark, d):
    return T.path_entries(table(spark, d, "pages").select(F.col("page_id").alias("node"), T.url_parts(F.col("url")).alias("parts")))


@query(f"SELECT child AS path, (len(string_split(child, '/')))::INT AS depth, kind FROM {SQL_ENTRIES}")
def path_expand(spark, d):
    e = entries(spark, d)
    roots = spark.createDataFrame([("", "")], "path string, key string")
    out = graph.expand_paths(roots, e.select("dir", "name", "child")).where("depth > 0")
    return out.join(e.select(F.col("child").alias("key"), "kind"), "key").select("path", "depth", "kind")


SQL_WANTED = f"(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN list_append(p, 'none') ELSE p END AS p FROM (SELECT page_id, {SQL_PARTS} AS p FROM pages))"


@query(f"SELECT page_id AS path, page_id % 3 <> 0 AS found, CASE WHEN page_id % 3 <> 0 THEN array_to_string(p, '/') END AS node FROM {SQL_WANTED}")
def path_resolve(spark, d):
    parts = T.url_parts(F.col("url"))
    wanted = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.when(F.col("page_id") % 3 == 0, F.concat(parts, F.array(F.lit("none")))).otherwise(parts).alias("parts"))
    return T.resolve(wanted, entries(spark, d))


@query(f"SELECT page_id AS path, (i + 1)::INT AS step, p[i + 1] AS name, array_to_string(p[1:i + 1], '/') AS node FROM (SELECT page_id, p, unnest(range(0, len(p))) AS i FROM (SELECT page_id, {SQL_PARTS} AS p FROM pages))")
def path_proof_spine(spark, d):
    wanted = table(spark, d, "pages").select(F.col("page_id").alias("path"), T.url_parts(F.col("url")).alias("parts"))
    return T.resolve(wanted, entries(spark, d), keep_spine=True)


@query(f"SELECT child AS path FROM {SQL_ENTRIES} WHERE kind = 'file' AND name NOT LIKE '%9'")
def view_checkout_paths(spark, d):
    return entries(spark, d).where("kind = 'file' AND name NOT LIKE '%9'").select(F.col("child").alias("path"))


@query(f"SELECT dir, count(*)::BIGINT AS files, count(*) FILTER (WHERE name LIKE '%7')::BIGINT AS matching, count(*) FILTER (WHERE name LIKE '%7') = 1 AS unique_match FROM {SQL_ENTRIES} WHERE kind = 'file' GROUP BY dir")
def executable_selection(spark, d):
    match = F.count(F.when(F.col("name").like("%7"), 1))
    return entries(spark, d).where("kind = 'file'").groupBy("dir").agg(F.count("*").alias("files"), match.alias("matching"), (match == 1).alias("unique_match"))


SQL_DIRS = "(SELECT DISTINCT l_orderkey AS dir, l_linenumber AS name, l_partkey AS child, l_quantity::BIGINT AS size FROM lineitem)"
#: One entry for each name: of several the smallest.
SQL_TREE = "(SELECT l_orderkey AS dir, l_linenumber AS name, min(l_partkey) AS child, min(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1, 2)"


def tree(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("name")).agg(F.min("l_partkey").alias("child"), F.min("l_quantity").cast("long").alias("size"))


_FRAMED = "length(name::VARCHAR) || ':' || name || length(child::VARCHAR) || ':' || child || length(size::VARCHAR) || ':' || size"


@query(f"SELECT dir, sha256(count(*) || ';' || string_agg({_FRAMED}, '' ORDER BY name)) AS digest FROM {SQL_TREE} GROUP BY dir")
def directory_digest(spark, d):
    return T.directory_digests(tree(spark, d))


def _level(kind: str) -> str:
    child = f"'{kind}:' || child"
    framed = f"length(name) || ':' || name || length({child}) || ':' || {child} || length(size::VARCHAR) || ':' || size"
    return f"sha256(count(*) || ';' || string_agg({framed}, '' ORDER BY name))"


#: Documents as files source/lang/doc_id: the entries of every directory, bottom up, and the root.
SQL_MERKLE = f"""WITH f AS (SELECT coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, doc_id::VARCHAR AS name, sha256(coalesce(text, '')) AS child, strlen(coalesce(text, ''))::BIGINT AS size FROM documents),
d1 AS (SELECT s, l AS name, {_level('file')} AS child, count(*)::BIGINT AS size FROM f GROUP BY s, l),
d2 AS (SELECT s AS name, {_level('directory')} AS child, sum(size + 1)::BIGINT AS size FROM d1 GROUP BY s),
d3 AS (SELECT {_level('directory')} AS child, sum(size + 1)::BIGINT AS size FROM d2)
SELECT d1.child AS dir, f.name, f.child, 'file' AS kind, f.size FROM f JOIN d1 ON f.s = d1.s AND f.l = d1.name
UNION SELECT d2.child, d1.name, d1.child, 'directory', d1.size FROM d1 JOIN d2 ON d1.s = d2.name
UNION SELECT d3.child, d2.name, d2.child, 'directory', d2.size FROM d2, d3
UNION ALL SELECT NULL, 'documents', child, 'root', NULL FROM d3"""


@query(SQL_MERKLE)
def tree_merkle_digests(spark, d):
    docs, text = table(spark, d, "documents"), F.coalesce("text", F.lit(""))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    f = build_tree(docs.select(F.lit("0").alias("root"), path.alias("path"), F.sha2(text, 256).alias("blob_id"), F.octet_length(text).cast("long").alias("size")), {"0": "documents"}, spark)
    root = f.roots.select(F.lit(None).cast("string").alias("dir"), "name", F.col("target").alias("child"), F.lit("root").alias("kind"), F.lit(None).cast("long").alias("size"))
    return f.entries.select(root.columns).unionByName(root)


@query("SELECT l_orderkey AS dir, l_linenumber AS name, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def directory_duplicate_names(spark, d):
    return T.duplicate_names(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("name")))


@query(f"SELECT name, child, size FROM {SQL_TREE} WHERE dir = 101")
def tree_list(spark, d):
    return tree(spark, d).where("dir = 101").select("name", "child", "size").orderBy("name")


@query(f"SELECT dir, child FROM {SQL_TREE} WHERE name = 3")
def view_lookup(spark, d):
    return tree(spark, d).where("name = 3").select("dir", "child")


@query(f"SELECT dir, count(*)::BIGINT AS entries, sum(size)::BIGINT AS bytes FROM {SQL_TREE} GROUP BY dir")
def view_entries(spark, d):
    return tree(spark, d).groupBy("dir").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query(f"SELECT CASE WHEN l_linestatus = 'F' THEN 'file' ELSE 'symlink' END AS kind, l_returnflag = 'A' AS executable, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS size FROM lineitem GROUP BY ALL")
def node_attributes(spark, d):
    kind = F.when(F.col("l_linestatus") == "F", "file").otherwise("symlink")
    return table(spark, d, "lineitem").groupBy(kind.alias("kind"), (F.col("l_returnflag") == "A").alias("executable")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("size"))


SQL_WANT_TREE = f"(SELECT dir, name, CASE WHEN child % 10 = 0 THEN child + 1 ELSE child END AS child FROM {SQL_TREE} WHERE dir % 5 <> 0 UNION ALL SELECT dir, 99, 1 FROM {SQL_TREE} WHERE name = 1 AND dir % 7 = 0)"


def wanted_tree(spark, d):
    t = tree(spark, d)
    w = t.where("dir % 5 <> 0").select("dir", "name", F.when(F.col("child") % 10 == 0, F.col("child") + 1).otherwise(F.col("child")).alias("child"))
    return w.union(t.where("name = 1 AND dir % 7 = 0").select("dir", F.lit(99), F.lit(1)))


@query(f"SELECT dir, name, CASE WHEN h.child IS NULL THEN 'added' WHEN w.child IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {SQL_TREE} h FULL JOIN {SQL_WANT_TREE} w USING (dir, name) WHERE h.child IS DISTINCT FROM w.child")
def tree_diff(spark, d):
    return T.diff(tree(spark, d), wanted_tree(spark, d), ["dir", "name"], "child")


@query(f"SELECT w.child AS wanted, min(h.child) AS held FROM {SQL_TREE} h JOIN {SQL_WANT_TREE} w USING (dir, name) WHERE h.child <> w.child GROUP BY w.child")
def slice_hints(spark, d):
    w = wanted_tree(spark, d).withColumnRenamed("child", "wanted")
    return tree(spark, d).join(w, ["dir", "name"]).where("child <> wanted").groupBy("wanted").agg(F.min("child").alias("held"))


NAME = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '://', '/') WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN '' WHEN 4 THEN repeat('x', 300) ELSE 'ok/' || page_id END"


@query(f"""WITH n AS (SELECT {NAME} AS name FROM pages), s AS (SELECT name, list_filter(list_transform(string_split(name, '/'), lambda s: CASE WHEN length(s) = 0 THEN 'empty segment' WHEN s IN ('.', '..') THEN 'dot segment'
WHEN octet_length(encode(s)) > 255 THEN 'segment too long' WHEN regexp_matches(s, '[\\x00-\\x1F\\x7F]') THEN 'control' END), lambda e: e IS NOT NULL) AS bad FROM n)
SELECT coalesce(CASE WHEN name = '' THEN 'empty' WHEN octet_length(encode(name)) > 1024 THEN 'too long' ELSE bad[1] END, 'valid') AS reason, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def root_name_validation(spark, d):
    k = F.col("page_id") % 6
    name = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "://", "/")).when(k == 2, F.concat(F.lit("a/../"), "page_id")).when(k == 3, "").when(k == 4, "x" * 300).otherwise(F.concat(F.lit("ok/"), "page_id"))
    return table(spark, d, "pages").select(F.coalesce(I.root_name_error(name), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


REF = "CASE page_id % 5 WHEN 0 THEN 'refs/heads/p' || page_id WHEN 1 THEN 'refs/heads/a..b' WHEN 2 THEN 'heads/main' WHEN 3 THEN 'refs/tags/.x' ELSE 'refs/tags/v.lock' END"


@query(f"SELECT {REF} AS name, page_id % 5 = 0 AS valid, count(*)::BIGINT AS n FROM pages GROUP BY ALL")
def ref_name_validation(spark, d):
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit("refs/heads/p"), "page_id")).when(k == 1, "refs/heads/a..b").when(k == 2, "heads/main").when(k == 3, "refs/tags/.x").otherwise("refs/tags/v.lock")
    return table(spark, d, "pages").select(name.alias("name")).withColumn("valid", I.ref_name_ok(F.col("name"))).groupBy("name", "valid").agg(F.count("*").alias("n"))


@query("SELECT url, 'ws/' || array_to_string(list_filter(string_split(url, '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS name FROM pages")
def auto_root_name(spark, d):
    return table(spark, d, "pages").select("url", I.nested_name(F.lit("ws"), F.col("url")).alias("name"))


@query("SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE') THEN 'html' WHEN contains(substr(html, 1, 1024), '<html') THEN 'fragment' ELSE 'unknown' END AS importer FROM pages")
def importer_detection(spark, d):
    head = F.substring("html", 1, 1024)
    return table(spark, d, "pages").select("page_id", F.when(head.startswith("<!DOCTYPE"), "html").when(head.contains("<html"), "fragment").otherwise("unknown").alias("importer"))


#: Each document against the next of its source and language.
SQL_PAIRS = "(SELECT doc_id AS id, text AS target, base FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS base FROM documents) WHERE base IS NOT NULL)"


def pairs(spark, d):
    from pyspark.sql import Window as W

    x = table(spark, d, "documents").withColumn("base", F.lag("text").over(W.partitionBy("source", "lang").orderBy("doc_id")))
    return x.where("base IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("target"), "base")


@query(f"""WITH p AS {SQL_PAIRS}, t AS (SELECT id, unnest(string_split(target, chr(10))) AS line, base FROM p)
SELECT id, sum(CASE WHEN list_contains(string_split(base, chr(10)), line) THEN octet_length(encode(line)) ELSE 0 END)::BIGINT AS copy_bytes, sum(CASE WHEN list_contains(string_split(base, chr(10)), line) THEN 0 ELSE octet_length(encode(line)) END)::BIGINT AS literal_bytes FROM t GROUP BY id""")
def line_delta(spark, d):
    x = T.line_delta(pairs(spark, d))
    copied = F.col("source").isNotNull()
    return x.groupBy("id").agg(F.sum(F.when(copied, F.col("bytes")).otherwise(0)).alias("copy_bytes"), F.sum(F.when(copied, 0).otherwise(F.col("bytes"))).alias("literal_bytes"))


@query(f"SELECT id, true AS ok FROM {SQL_PAIRS}")
def delta_decode_roundtrip(spark, d):
    p = pairs(spark, d)
    again = T.apply_line_delta(T.line_delta(p), p.select("id", "base"))
    return p.select("id", "target").join(again, "id").select("id", (F.col("content") == F.col("target")).alias("ok"))


def commits(spark, d):
    c = table(spark, d, "conversations")
    key = lambda t: F.concat_ws(":", "conv_id", t)
    return c.select("conv_id", "turn", key(F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") > 0, key((F.col("turn") - 1).cast("string"))).alias("parent"))


def tips(c):
    t = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return t.select("conv_id", F.concat_ws(":", "conv_id", F.col("turn").cast("string")).alias("id"))


SQL_TIP = "(SELECT conv_id, max(turn) AS tip FROM conversations GROUP BY conv_id)"


@query(f"SELECT conv_id, count(*)::BIGINT AS selected, bool_or(turn > 0 AND tip - turn + 1 >= 3) AS shallow FROM conversations JOIN {SQL_TIP} USING (conv_id) WHERE tip - turn + 1 <= 3 GROUP BY conv_id")
def shallow_history(spark, d):
    c = commits(spark, d)
    h = T.history(c.select("id", "parent"), tips(c), depth=3).join(c.select("id", "conv_id"), "id")
    return h.groupBy("conv_id").agg(F.count("*").alias("selected"), F.bool_or("shallow").alias("shallow"))


@query(f"SELECT conv_id, turn FROM conversations JOIN {SQL_TIP} USING (conv_id) WHERE turn > 1")
def wants_minus_haves(spark, d):
    c = commits(spark, d)
    haves = c.where("turn = 1").select("id")
    return T.history(c.select("id", "parent"), tips(c), haves).join(c, "id").select("conv_id", "turn")


@query(f"SELECT role, count(*)::BIGINT AS objects, sum(length(text))::BIGINT AS size FROM conversations JOIN {SQL_TIP} USING (conv_id) WHERE turn > 1 OR conv_id % 2 = 0 GROUP BY role")
def pack_selection(spark, d):
    c = commits(spark, d)
    haves = c.where("turn = 1 AND conv_id % 2 = 1").select("id")
    picked = T.history(c.select("id", "parent"), tips(c), haves).join(c, "id").select("conv_id", "turn")
    return table(spark, d, "conversations").join(picked, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("objects"), F.sum(F.length("text")).alias("size"))


@query(f"SELECT 'git/view/' || conv_id AS root, tip + 1 AS objects FROM {SQL_TIP}")
def publish_view(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("objects")).select(F.concat(F.lit("git/view/"), "conv_id").alias("root"), "objects")


@query(f"SELECT 'refs/heads/c' || conv_id AS name, sha1(encode(conv_id || ':' || tip)) AS oid, row_number() OVER (ORDER BY 'refs/heads/c' || conv_id) - 1 AS position FROM {SQL_TIP}")
def info_refs(spark, d):
    t = tips(commits(spark, d)).select(F.concat(F.lit("refs/heads/c"), "conv_id").alias("name"), F.sha1("id").alias("oid"))
    return numbered(t, ["name"], "position")


PKT = "CASE turn % 4 WHEN 0 THEN 'want ' || sha1(encode(conv_id || '')) || ' caps' WHEN 1 THEN 'have ' || sha1(encode(conv_id || ':' || turn)) WHEN 2 THEN 'deepen ' || turn ELSE 'done' END"


@query(f"SELECT conv_id, turn, split_part({PKT}, ' ', 1) AS command, CASE WHEN turn % 4 < 3 THEN split_part({PKT}, ' ', 2) END AS argument, turn % 4 <= 1 AND length(split_part({PKT}, ' ', 2)) = 40 AS valid_oid FROM conversations")
def parse_wants_haves(spark, d):
    k = F.col("turn") % 4
    pkt = F.when(k == 0, F.concat(F.lit("want "), F.sha1(F.col("conv_id").cast("string")), F.lit(" caps"))).when(k == 1, F.concat(F.lit("have "), F.sha1(F.concat_ws(":", "conv_id", "turn")))).when(k == 2, F.concat(F.lit("deepen "), "turn")).otherwise("done")
    x = table(spark, d, "conversations").select("conv_id", "turn", F.split(pkt, " ").alias("w"))
    arg = F.get("w", F.lit(1))
    return x.select("conv_id", "turn", F.col("w")[0].alias("command"), arg.alias("argument"), F.coalesce(F.col("w")[0].isin("want", "have") & arg.rlike("^[0-9a-f]{40}$"), F.lit(False)).alias("valid_oid"))


@query("SELECT conv_id || ':' || turn AS id, conv_id || ':0' AS target, turn::INT AS rounds, NULL::VARCHAR AS error FROM conversations")
def hardlink_resolution(spark, d):
    return T.resolve_hardlinks(commits(spark, d).select("id", F.col("parent").alias("link")))


@query("""SELECT n_name AS name, CASE WHEN n_nationkey = 24 THEN NULL ELSE 'oid' || n_nationkey % 5 END AS target, (n_nationkey // 5 + CASE WHEN n_nationkey = 24 THEN 1 ELSE 0 END)::INT AS hops, CASE WHEN n_nationkey = 24 THEN 'missing' END AS error FROM nation WHERE n_nationkey <> 24
UNION ALL SELECT n_name, NULL, 1, 'missing' FROM nation WHERE n_nationkey = 24 UNION ALL SELECT 'loop' || i, NULL, 1, 'cycle' FROM range(0, 2) t(i)""")
def symbolic_ref_resolution(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    to = n.select((F.col("n_nationkey") + 5).alias("n_nationkey"), F.col("name").alias("up"))
    direct = F.col("n_nationkey") < 5
    target = F.when(direct, F.concat(F.lit("oid"), F.col("n_nationkey") % 5)).when(F.col("n_nationkey") == 24, "nowhere").otherwise(F.col("up"))
    refs = n.join(to, "n_nationkey", "left").select("name", target.alias("target"), (~direct).alias("symbolic"))
    loops = spark.createDataFrame([("loop0", "loop1", True), ("loop1", "loop0", True)], "name string, target string, symbolic boolean")
    return graph.resolve_symbolic(refs.union(loops))
