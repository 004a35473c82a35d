"""Blobs, chunks, manifests, packs and the identities that name them, over the documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.functions import identity as I
from merkleframe.operators import storage as S
from merkleframe.operators.order import numbered
from merkleframe.plans.base import SQL_CHUNKS, Plans, blobs, lines
from merkleframe.session import table

P = Plans()
query = P.query
QUERIES, ORACLE = P.queries, P.oracle

B = "(SELECT doc_id, source, text, sha256(text) AS blob_id, octet_length(encode(text))::BIGINT AS size FROM documents)"
SLICE = 512
#: Slices of 512 characters of each document.
SQL_SLICES = f"""(SELECT doc_id, i::INT AS ordinal, substr(text, (i * {SLICE} + 1)::INT, {SLICE}) AS chunk FROM documents, unnest(range(0, greatest(1, (length(text) + {SLICE - 1}) // {SLICE}))) u(i))"""


def slices(spark, d):
    return S.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), SLICE)


@query(f"SELECT doc_id, blob_id AS digest FROM {B}")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", I.digest(F.col("text")).alias("digest"))


BAD_HEX = "CASE doc_id % 4 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, 62) WHEN 2 THEN 'zz' || substr(h, 3) ELSE upper(h) END"


@query(f"SELECT doc_id, CASE WHEN length(t) = 64 AND regexp_full_match(t, '[0-9a-fA-F]*') THEN lower(t) END AS digest FROM (SELECT doc_id, {BAD_HEX} AS t FROM (SELECT doc_id, sha256(text) AS h FROM documents))")
def digest_hex_validation(spark, d):
    x = table(spark, d, "documents").select("doc_id", I.digest(F.col("text")).alias("h"))
    x = x.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("h")).when(F.col("doc_id") % 4 == 1, F.substring("h", 1, 62)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("zz"), F.substring("h", 3, 62))).otherwise(F.upper("h")).alias("t"))
    return x.select("doc_id", F.lower(F.hex(I.from_hex(F.col("t")))).alias("digest"))


_B64 = "rtrim(translate(base64(unhex(sha256(text))), '+/', '-_'), '=')"


@query(f"SELECT doc_id, 'doc.blob.v1:' || {_B64} AS key_text, 'sha256-' || {_B64} AS digest_text, true AS round_trip FROM documents")
def object_key_text(spark, d):
    b = F.unhex(I.digest(F.col("text")))
    back = I.from_base64url(I.base64url(b)) == b
    return table(spark, d, "documents").select("doc_id", I.key_text(F.lit("doc.blob.v1"), b).alias("key_text"), I.digest_text(b).alias("digest_text"), back.alias("round_trip"))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY 'geo.r' || n_regionkey || '.v1', encode(n_name))::INT AS rank FROM nation")
def object_key_order(spark, d):
    ns = F.concat(F.lit("geo.r"), F.col("n_regionkey"), F.lit(".v1"))
    n = table(spark, d, "nation").select("n_nationkey", ns.alias("namespace"), F.encode("n_name", "UTF-8").alias("native_id"))
    return numbered(n, ["namespace", "native_id"], "rank", 1).select("n_nationkey", F.col("rank").cast("int").alias("rank"))


NS = "CASE user_id % 5 WHEN 0 THEN 'ev.' || event_type || '.v1' WHEN 1 THEN event_type WHEN 2 THEN 'Ev.v1' WHEN 3 THEN 'é.v1' ELSE repeat('a', 62) || '.v1' END"


@query(f"""SELECT ns AS namespace, CASE WHEN length(ns) = 0 THEN 'empty' WHEN octet_length(encode(ns)) > 64 THEN 'too long' WHEN octet_length(encode(ns)) <> length(ns) THEN 'not ascii'
WHEN NOT regexp_full_match(ns, '[a-z][a-z0-9-]*(\\.[a-z][a-z0-9-]*)*\\.v[0-9]+') THEN 'syntax' END AS error, count(*)::BIGINT AS n FROM (SELECT {NS} AS ns FROM events) GROUP BY ALL""")
def namespace_validation(spark, d):
    u = F.col("user_id") % 5
    ns = F.when(u == 0, F.concat(F.lit("ev."), "event_type", F.lit(".v1"))).when(u == 1, F.col("event_type")).when(u == 2, "Ev.v1").when(u == 3, "é.v1").otherwise(F.lit("a" * 62 + ".v1"))
    return table(spark, d, "events").select(ns.alias("namespace"), I.namespace_error(ns).alias("error")).groupBy("namespace", "error").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS sha1_oid, sha256(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS sha256_oid FROM documents")
def git_blob_ids(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", I.git_oid("blob", t).alias("sha1_oid"), I.git_oid("blob", t, "sha256").alias("sha256_oid"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def multi_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query(f"SELECT ('0x' || substr(sha256(text), 1, 2))::BIGINT // 16 AS prefix, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def shard_routing(spark, d):
    return table(spark, d, "documents").groupBy(I.shard_prefix(I.digest(F.col("text")), 4).alias("prefix")).agg(F.count("*").alias("n"))


@query(f"SELECT blob_id, any_value(size)::BIGINT AS size, count(*)::BIGINT AS names FROM {B} GROUP BY blob_id")
def blob_import(spark, d):
    return blobs(spark, d).groupBy("blob_id").agg(F.max("size").alias("size"), F.count("*").alias("names"))


@query(f"SELECT sum(size)::BIGINT AS logical_bytes, (SELECT sum(size)::BIGINT FROM (SELECT DISTINCT blob_id, size FROM {B})) AS physical_bytes, round(sum(size)::DOUBLE / (SELECT sum(size) FROM (SELECT DISTINCT blob_id, size FROM {B})), 9) AS ratio FROM {B}")
def blob_dedup_stats(spark, d):
    per = blobs(spark, d).groupBy("blob_id").agg(F.sum("size").alias("logical"), F.max("size").alias("physical"))
    return per.agg(F.sum("logical").alias("logical_bytes"), F.sum("physical").alias("physical_bytes"), F.round(F.sum("logical").cast("double") / F.sum("physical"), 9).alias("ratio"))


@query(f"""SELECT source, sum(n)::BIGINT AS chunks, count(*)::BIGINT AS distinct_chunks, sum((n - 1) * size)::BIGINT AS saved_bytes FROM (SELECT source, chunk_id, size, count(*) AS n FROM ({SQL_CHUNKS}) GROUP BY ALL) GROUP BY source""")
def line_chunk_dedup(spark, d):
    per = lines(spark, d).groupBy("source", "chunk_id", "size").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved_bytes"))


SQL_MANIFEST = f"""(SELECT doc_id, ordinal, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", size, chunk_id
FROM (SELECT doc_id, ordinal, octet_length(encode(chunk))::BIGINT AS size, sha256(chunk) AS chunk_id FROM {SQL_SLICES}))"""


@query(f'SELECT doc_id, ordinal, "offset", size, chunk_id FROM {SQL_MANIFEST}')
def fixed_chunk_manifest(spark, d):
    return S.manifest(slices(spark, d)).select("doc_id", "ordinal", "offset", "size", "chunk_id")


@query(f"SELECT sha256(text) AS blob_id, CASE WHEN length(text) <= {SLICE} THEN 0 ELSE ((length(text) + {SLICE - 1}) // {SLICE}) END::BIGINT AS manifest_rows, length(text) <= {SLICE} AS elided FROM documents")
def single_chunk_elision(spark, d):
    n = S.manifest(slices(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))
    b = blobs(spark, d).join(n, "doc_id")
    return b.select("blob_id", F.when(F.col("n") == 1, F.lit(0)).otherwise(F.col("n")).cast("long").alias("manifest_rows"), (F.col("n") == 1).alias("elided"))


RANGE = (700, 900)


@query(f'SELECT doc_id, ordinal, greatest("offset", {RANGE[0]})::BIGINT AS "from", least("offset" + size, {RANGE[0] + RANGE[1]})::BIGINT AS "to" FROM {SQL_MANIFEST} WHERE "offset" < {RANGE[0] + RANGE[1]} AND "offset" + size > {RANGE[0]}')
def range_read_plan(spark, d):
    return S.covering(S.manifest(slices(spark, d)), *RANGE).select("doc_id", "ordinal", "from", "to")


@query("SELECT doc_id, true AS ok FROM documents")
def blob_reassembly_check(spark, d):
    joined = S.reassembled(slices(spark, d)).select("doc_id", F.sha2("content", 256).alias("again"))
    return blobs(spark, d).join(joined, "doc_id").select("doc_id", (F.col("again") == F.col("blob_id")).alias("ok"))


@query(f'SELECT doc_id, ordinal, ({RANGE[0]} - "offset")::BIGINT AS skip FROM {SQL_MANIFEST} WHERE "offset" <= {RANGE[0]} AND "offset" + size > {RANGE[0]}')
def seek_to_offset(spark, d):
    at = S.covering(S.manifest(slices(spark, d)), RANGE[0], 1)
    return at.select("doc_id", "ordinal", (F.lit(RANGE[0]) - F.col("offset")).cast("long").alias("skip"))


@query(f'SELECT doc_id, ordinal, "offset" FROM {SQL_MANIFEST} WHERE "offset" <= 2048 AND "offset" + size > 2048')
def manifest_offset_lookup(spark, d):
    return S.covering(S.manifest(slices(spark, d)), 2048, 1).select("doc_id", "ordinal", "offset")


@query(f'SELECT doc_id, count(*)::BIGINT AS chunks, true AS verified FROM {SQL_MANIFEST} WHERE "offset" < {RANGE[0] + RANGE[1]} AND "offset" + size > {RANGE[0]} GROUP BY doc_id')
def verified_range_read(spark, d):
    m = S.covering(S.manifest(slices(spark, d)), *RANGE)
    return m.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.bool_and(F.sha2("chunk", 256) == F.col("chunk_id")).alias("verified"))


EDIT_AT = 600


@query(f"""SELECT doc_id, sha256(CASE WHEN length(text) > {EDIT_AT} THEN substr(text, 1, {EDIT_AT}) || '[edited]' || substr(text, {EDIT_AT + 9}) ELSE text END) AS blob_id,
CASE WHEN length(text) > {EDIT_AT} THEN 1 ELSE 0 END::BIGINT + CASE WHEN length(text) > {EDIT_AT} AND {EDIT_AT} // {SLICE} < ({EDIT_AT} + 7) // {SLICE} THEN 1 ELSE 0 END AS changed FROM documents""")
def blob_overwrite(spark, d):
    out = S.overwrite(slices(spark, d), EDIT_AT, "[edited]", SLICE)
    joined = S.reassembled(out).select("doc_id", F.sha2("content", 256).alias("blob_id"))
    return joined.join(out.groupBy("doc_id").agg(F.sum(F.col("changed").cast("long")).alias("changed")), "doc_id").select("doc_id", "blob_id", "changed")


PACK = f"(SELECT doc_id % 16 AS pack, doc_id, blob_id, size, coalesce(sum(size) OVER (PARTITION BY doc_id % 16 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lies FROM {B})"


@query(f'SELECT pack, doc_id, lies AS "offset", size FROM {PACK}')
def pack_offsets(spark, d):
    return S.pack_offsets(blobs(spark, d).withColumn("pack", F.col("doc_id") % 16), "pack", "doc_id").select("pack", "doc_id", "offset", "size")


@query(f"SELECT blob_id AS chunk_id, min(pack) AS pack, count(*)::BIGINT AS copies FROM {PACK} GROUP BY blob_id")
def chunk_location(spark, d):
    p = S.pack_offsets(blobs(spark, d).withColumn("pack", F.col("doc_id") % 16), "pack", "doc_id")
    return p.groupBy(F.col("blob_id").alias("chunk_id")).agg(F.min("pack").alias("pack"), F.count("*").alias("copies"))


@query(f"SELECT blob_id AS chunk_id, min(pack) AS pack FROM {PACK} WHERE pack <> 3 GROUP BY blob_id")
def pack_index_merge(spark, d):
    b = blobs(spark, d).withColumn("pack", F.col("doc_id") % 16)
    old, new = b.where("pack < 8").select("blob_id", "pack"), b.where("pack >= 8").select("blob_id", "pack")
    kept = old.join(spark.range(3, 4).select(F.col("id").alias("pack")), "pack", "left_anti").select("blob_id", "pack").union(new)
    return kept.groupBy(F.col("blob_id").alias("chunk_id")).agg(F.min("pack").alias("pack"))


@query(f"SELECT pack, count(*)::BIGINT AS chunks, max(lies + size)::BIGINT AS bytes FROM {PACK} GROUP BY pack")
def pack_index_rebuild(spark, d):
    p = S.pack_offsets(blobs(spark, d).withColumn("pack", F.col("doc_id") % 16), "pack", "doc_id")
    return p.groupBy("pack").agg(F.count("*").alias("chunks"), F.max(F.col("offset") + F.col("size")).alias("bytes"))


TARGET = 64 * 1024


@query(f"""WITH RECURSIVE s AS (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {B}),
g(source, r, pack, filled) AS (SELECT source, r, 0, size FROM s WHERE r = 1 UNION ALL
  SELECT s.source, s.r, CASE WHEN g.filled >= {TARGET} THEN g.pack + 1 ELSE g.pack END, CASE WHEN g.filled >= {TARGET} THEN s.size ELSE g.filled + s.size END FROM g JOIN s ON s.source = g.source AND s.r = g.r + 1)
SELECT source, pack::INT AS pack, count(*)::BIGINT AS blobs, max(filled)::BIGINT AS bytes FROM g GROUP BY source, pack""")
def pack_fill(spark, d):
    f = S.greedy_packs(blobs(spark, d).select("source", "doc_id", "size"), TARGET)
    return f.groupBy("source", "pack").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


SQL_SEALED = f"""WITH RECURSIVE s AS (SELECT source, doc_id, blob_id, size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {B}),
g(source, r, pack, filled) AS (SELECT source, r, 0, size FROM s WHERE r = 1 UNION ALL
  SELECT s.source, s.r, CASE WHEN g.filled >= {TARGET} THEN g.pack + 1 ELSE g.pack END, CASE WHEN g.filled >= {TARGET} THEN s.size ELSE g.filled + s.size END FROM g JOIN s ON s.source = g.source AND s.r = g.r + 1),
e AS (SELECT source, pack::INT AS pack, r, blob_id, (filled - size)::BIGINT AS lies, size::BIGINT AS size FROM g JOIN s USING (source, r)),
p AS (SELECT source, pack, count(*)::BIGINT AS blobs, sum(size)::BIGINT AS bytes, sha256(string_agg(blob_id || ':' || lies || ':' || size, chr(10) ORDER BY r)) AS pack_id FROM e GROUP BY source, pack)
"""


def sealed(spark, d):
    return S.seal_packs(S.greedy_packs(blobs(spark, d).select("source", "doc_id", "size", "blob_id"), TARGET))


@query(f"{SQL_SEALED} SELECT source, pack, blobs, bytes, pack_id FROM p")
def pack_seal(spark, d):
    return sealed(spark, d).drop("footer")


@query(f'{SQL_SEALED} SELECT pack_id, blob_id, lies AS "offset", size FROM e JOIN p USING (source, pack)')
def pack_footer_index(spark, d):
    return S.footer_index(sealed(spark, d))


@query(f"SELECT source, CASE WHEN n * 40 <= {TARGET} * 2 THEN 1 ELSE ceil(log2(ceil(n * 40 / {TARGET}::DOUBLE)))::INT END AS bits FROM (SELECT source, count(*) AS n FROM ({SQL_CHUNKS}) GROUP BY source)")
def shard_width(spark, d):
    n = lines(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", S.shard_bits(F.col("n"), 40, TARGET).alias("bits"))


@query(f"SELECT blob_id, size, doc_id % 2 = 0 AS found FROM (SELECT doc_id, blob_id, size FROM {B})")
def sidecar_lookup(spark, d):
    b = blobs(spark, d).select("doc_id", "blob_id", "size")
    side = b.where("doc_id % 2 = 0").select("doc_id", F.lit(True).alias("found"))
    return b.join(side, "doc_id", "left").select("blob_id", "size", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'near' WHEN doc_id % 5 <> 0 THEN 'far' ELSE 'absent' END AS tier, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def near_far_read(spark, d):
    b = blobs(spark, d).select("doc_id", "blob_id")
    got = S.tiered(b.where("doc_id % 3 = 0"), b.where("doc_id % 5 <> 0"), "doc_id", "blob_id")
    return b.select("doc_id").join(got, "doc_id", "left").groupBy(F.coalesce("tier", F.lit("absent")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN doc_id % 10 <> 0 THEN 'keep' WHEN doc_id % 20 = 0 THEN 'repair' ELSE 'lost' END AS action, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def repair_plan(spark, d):
    b = blobs(spark, d).select("doc_id", "blob_id", "text")
    near = b.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    far = b.withColumn("text", F.when(F.col("doc_id") % 20 == 10, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return S.repair(near, far, "doc_id").groupBy("action").agg(F.count("*").alias("n"))


PROOF_LEAF = 3


@query(f"""WITH RECURSIVE leaf AS (SELECT doc_id, ordinal, sha256(chunk) AS h FROM {SQL_SLICES}),
tree(doc_id, level, list) AS (SELECT doc_id, 0, list(h ORDER BY ordinal) FROM leaf GROUP BY doc_id HAVING count(*) > {PROOF_LEAF}
  UNION ALL SELECT doc_id, level + 1, list_transform(range(0, (len(list) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(list) THEN sha256(list[2 * i + 1] || list[2 * i + 2]) ELSE list[2 * i + 1] END) FROM tree WHERE len(list) > 1),
root AS (SELECT doc_id, list[1] AS root FROM tree WHERE len(list) = 1),
spot AS (SELECT doc_id, level, list, {PROOF_LEAF} // (2 ** level)::BIGINT AS i FROM tree WHERE len(list) > 1)
SELECT doc_id, root, level::INT AS level, list[xor(i, 1) + 1] AS sibling FROM spot JOIN root USING (doc_id) WHERE xor(i, 1) < len(list)""")
def merkle_proof(spark, d):
    return S.merkle_proofs(slices(spark, d), PROOF_LEAF)


@query(f"SELECT doc_id % 4 = 0 AS hit, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM {B} GROUP BY 1")
def ingest_cache_hits(spark, d):
    b = blobs(spark, d).select("doc_id", "size", F.lit(1).alias("mtime"))
    cache = b.where("doc_id % 4 < 2").select("doc_id", F.col("size").alias("c_size"), F.when(F.col("doc_id") % 4 == 0, F.col("mtime")).otherwise(F.lit(0)).alias("c_mtime"))
    hit = (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime"))
    return b.join(cache, "doc_id", "left").groupBy(F.coalesce(hit, F.lit(False)).alias("hit")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"SELECT count(DISTINCT blob_id)::BIGINT AS blobs, (SELECT count(DISTINCT chunk_id)::BIGINT FROM ({SQL_CHUNKS})) AS chunks FROM {B}")
def physical_inventory(spark, d):
    c = lines(spark, d).agg(F.countDistinct("chunk_id").alias("chunks"))
    return blobs(spark, d).agg(F.countDistinct("blob_id").alias("blobs")).select("blobs", c.scalar().alias("chunks"))


@query(f"SELECT doc_id, blob_id, blob_id IN (SELECT blob_id FROM {B} WHERE doc_id % 3 <> 0) AS present FROM {B}")
def blob_presence_batch(spark, d):
    b = blobs(spark, d).select("doc_id", "blob_id")
    return S.flagged(b, b.where("doc_id % 3 <> 0").select("blob_id"), "blob_id", "present")


@query(f"SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE blob_id IN (SELECT blob_id FROM {B} WHERE doc_id % 2 = 0))::BIGINT AS members FROM {B} GROUP BY source")
def membership_flags(spark, d):
    b = blobs(spark, d).select("doc_id", "source", "blob_id")
    x = S.flagged(b, b.where("doc_id % 2 = 0").select("blob_id"), "blob_id", "member")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("member"), 1)).alias("members"))


@query(f"SELECT doc_id, blob_id, row_number() OVER (PARTITION BY blob_id ORDER BY doc_id) = 1 AND blob_id NOT IN (SELECT blob_id FROM {B} WHERE doc_id % 7 = 0) AS inserted FROM {B}")
def insert_batch_flags(spark, d):
    b = blobs(spark, d).select("doc_id", "blob_id")
    return S.insert_flags(b, b.where("doc_id % 7 = 0").select("blob_id"), "blob_id", "doc_id")


@query(f"SELECT blob_id FROM (SELECT blob_id FROM {B} EXCEPT SELECT blob_id FROM {B} WHERE doc_id % 3 = 0)")
def ordered_difference(spark, d):
    b = blobs(spark, d)
    return b.select("blob_id").subtract(b.where("doc_id % 3 = 0").select("blob_id")).orderBy("blob_id")


@query(f"SELECT blob_id, row_number() OVER (ORDER BY blob_id)::BIGINT AS rn FROM (SELECT DISTINCT blob_id FROM {B} WHERE blob_id > '80') ORDER BY blob_id LIMIT 50")
def frozen_set_page(spark, d):
    page = blobs(spark, d).select("blob_id").distinct().where("blob_id > '80'").orderBy("blob_id").limit(50)
    return page.withColumn("rn", F.row_number().over(W.orderBy("blob_id")).cast("long"))


@query(f"SELECT blob_id AS identity, row_number() OVER (ORDER BY blob_id)::BIGINT AS rn FROM (SELECT DISTINCT blob_id FROM {B} WHERE size > 0 AND blob_id > '40') ORDER BY blob_id LIMIT 100")
def facts_page(spark, d):
    page = blobs(spark, d).where("size > 0 AND blob_id > '40'").select(F.col("blob_id").alias("identity")).distinct().orderBy("identity").limit(100)
    return page.withColumn("rn", F.row_number().over(W.orderBy("identity")).cast("long"))


@query(f"SELECT doc_id, size, upto FROM (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id)::BIGINT AS upto, row_number() OVER (ORDER BY doc_id) AS r FROM {B}) WHERE r <= 256 AND (upto <= 100000 OR r = 1)")
def page_by_bytes(spark, d):
    return S.page_by_bytes(blobs(spark, d).select("doc_id", "size"), "doc_id", 256, 100_000)


@query(f"SELECT doc_id % 2 = 0 AS destination, count(*)::BIGINT AS objects, count(DISTINCT blob_id)::BIGINT AS payloads FROM {B} GROUP BY 1")
def copy_import(spark, d):
    return blobs(spark, d).groupBy((F.col("doc_id") % 2 == 0).alias("destination")).agg(F.count("*").alias("objects"), F.countDistinct("blob_id").alias("payloads"))


@query(f"SELECT source, sum(size)::BIGINT AS apparent_bytes, (sum((size + 4095) // 4096 * 4096))::BIGINT AS allocated_bytes, count(*)::BIGINT AS files FROM {B} GROUP BY source")
def storage_usage(spark, d):
    blocks = F.ceil(F.col("size") / 4096) * 4096
    return blobs(spark, d).groupBy("source").agg(F.sum("size").alias("apparent_bytes"), F.sum(blocks).alias("allocated_bytes"), F.count("*").alias("files"))


@query(f"SELECT doc_id, blob_id, size, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN doc_id % 3 = 0 THEN size ELSE 0 END, doc_id) - 1 AS position FROM {B}")
def git_pack_order(spark, d):
    tree = F.col("doc_id") % 3 == 0
    x = blobs(spark, d).select("doc_id", "blob_id", "size", F.when(tree, 0).otherwise(1).alias("a"), F.when(tree, F.col("size")).otherwise(0).alias("b"))
    return numbered(x, ["a", "b", "doc_id"], "position").select("doc_id", "blob_id", "size", "position")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS idx FROM part")
def dense_catalog_index(spark, d):
    return numbered(table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand", "p_partkey"], "idx").select("p_partkey", "idx")


@query(f"SELECT blob_id AS oid, list_sort(list_distinct(list(CASE WHEN doc_id % 5 = 0 THEN 'tree' ELSE 'blob' END)))::VARCHAR AS kinds, count(DISTINCT doc_id % 5 = 0) > 1 AS ambiguous FROM {B} GROUP BY blob_id")
def oid_index(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "tree").otherwise("blob")
    x = blobs(spark, d).groupBy(F.col("blob_id").alias("oid")).agg(F.array_sort(F.collect_set(kind)).alias("k"))
    return x.select("oid", F.concat(F.lit("["), F.array_join("k", ", "), F.lit("]")).alias("kinds"), (F.size("k") > 1).alias("ambiguous"))


@query(f"SELECT doc_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 4096 THEN 'large' ELSE 'small' END AS class, doc_id % 3 <> 0 AS near FROM {B}")
def split_source(spark, d):
    b = blobs(spark, d)
    kind = F.when(F.col("size") == 0, "empty").when(F.col("size") > 4096, "large").otherwise("small")
    records, payloads = b.select("doc_id", "size"), b.where("doc_id % 3 <> 0").select("doc_id", F.lit(True).alias("near"))
    return records.join(payloads, "doc_id", "left").select("doc_id", kind.alias("class"), F.coalesce("near", F.lit(False)).alias("near"))


@query("SELECT sha256(text) AS identity, min(doc_id)::BIGINT AS first_doc FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def missing_measurements(spark, d):
    b = blobs(spark, d)
    facts = b.where("doc_id % 2 = 0").select("blob_id")
    return b.join(facts, "blob_id", "left_anti").groupBy(F.col("blob_id").alias("identity")).agg(F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AS complete FROM documents")
def measurement_completeness(spark, d):
    i = F.col("doc_id")
    facts = F.map_from_entries(F.filter(F.array(F.when(i % 2 == 0, F.struct(F.lit("sha256").alias("k"), F.lit("x").alias("v"))), F.when(i % 3 == 0, F.struct(F.lit("md5").alias("k"), F.lit("y").alias("v")))), lambda e: e.isNotNull()))
    have = F.map_keys(facts)
    return table(spark, d, "documents").select("doc_id", F.forall(F.array(F.lit("sha256"), F.lit("md5")), lambda k: F.array_contains(have, k)).alias("complete"))


@query(f"SELECT CASE WHEN doc_id % 4 = 0 THEN 'tree.v1' ELSE 'blob.v1' END AS namespace, count(*)::BIGINT AS checked, count(*) FILTER (WHERE doc_id % 9 = 0)::BIGINT AS invalid FROM documents GROUP BY 1")
def format_verify_counts(spark, d):
    b = blobs(spark, d).withColumn("stored", F.when(F.col("doc_id") % 9 == 0, F.reverse("blob_id")).otherwise(F.col("blob_id")))
    ns = F.when(F.col("doc_id") % 4 == 0, "tree.v1").otherwise("blob.v1")
    return b.groupBy(ns.alias("namespace")).agg(F.count("*").alias("checked"), F.count(F.when(F.sha2("text", 256) != F.col("stored"), 1)).alias("invalid"))


@query("""WITH n AS (SELECT DISTINCT unnest(string_split(text, '. ')) AS needle FROM benchmark)
SELECT needle, (SELECT count(*) FROM documents d WHERE contains(d.text, needle))::BIGINT AS hits FROM n WHERE needle <> ''""")
def needle_scan(spark, d):
    needles = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("needle")).where("needle <> ''").distinct()
    return S.needle_hits(table(spark, d, "documents").select("doc_id", "text"), needles)


SQL_CAND = f"(SELECT chunk_id AS key, doc_id, ordinal, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id DESC, ordinal DESC) AS r FROM ({SQL_CHUNKS}) WHERE ('0x' || substr(chunk_id, 1, 2))::BIGINT % 4 = 0)"


@query(f"SELECT key, count(*)::BIGINT AS candidates, min(doc_id)::BIGINT AS oldest FROM {SQL_CAND} WHERE r <= 8 GROUP BY key")
def sampled_index(spark, d):
    return S.sampled_index(lines(spark, d), 8).groupBy("key").agg(F.count("*").alias("candidates"), F.min("doc_id").alias("oldest"))


def fastcdc_chunks(spark, d):
    return S.content_chunks(table(spark, d, "documents").select("doc_id", "text"))


def zstd_chunk_sizes(spark, d):
    return S.compressed_sizes(table(spark, d, "documents").select("doc_id", "text"))


QUERIES |= {"fastcdc_chunks": fastcdc_chunks, "zstd_chunk_sizes": zstd_chunk_sizes}
