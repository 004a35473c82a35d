"""N-gram Jaccard join by grouped prefixes: which documents have shingle sets of a Jaccard similarity of 0.85 or more.

1. A sketch counts every shingle of every document in 2^20 counters. It orders shingles, rare ones first; its size is
   fixed, and any order gives the same links.
2. Documents of equal sets are one class; classes of equal size and prefix (the rarest 15 % of the set, of which two
   linked sets share one at least) are one group. Only groups post their prefix shingles.
3. Postings meet by shingle. A shingle that may be in many groups is salted, by the sketch. What is in one group only
   goes at once.
4. Group pairs are filtered by size and by the positions of the shared shingle. The pairs that remain are expanded to
   their members, and these are verified by their whole sets: first a star to one member of each shingle and size band,
   whose components are found; then every pair that a shared shingle still leaves across two components. Pairs within a
   component can't change it and are never made, so a group of thousands of copies costs thousands of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.llm import arrays as A
from merkleframe.llm.components import components
from merkleframe.llm.text import BLANKS, LOWER, UPPER, fresh
from merkleframe.session import discard, table, written

SHINGLE = 4
#: Similarity, in hundredths.
PERCENT = 85
COUNTERS = 1 << 20
BLOCK = 1 << 16
#: Rows of one shingle that are dealt to one task at most, by the sketch.
HOT = 4000
#: Rows of a few numbers each, some 100 bytes in memory, that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 250_000
#: Pairs of one document, and postings of one shingle and band, beyond which these are salted; or a 50,000th of all if that is
#: more, so that 50,000 keys are salted at most.
CENTRE, CROWD = 32, 500
#: Bits for each wanted document in the filter of step 4, and the most there are.
BLOOM_BITS, MAX_BLOOM = 16, 1 << 28


def _sets(text: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text."""
    text = text.fill_null("") if text.null_count else text
    for a, b in A.slices(text):
        buf, offsets = A.text_bytes(text.slice(a, b - a))
        buf = A.LOWER[buf]
        starts, ends, rows = A.words(buf, offsets)
        bounds = A.per_row(rows, b - a)
        h, at = A.shingles(A.segment_hashes(buf, starts, ends), bounds, size)
        cut = np.searchsorted(at, bounds)
        for r in range(b - a):
            yield a + r, np.unique(h[cut[r] : cut[r + 1]])
    pa.default_memory_pool().release_unused()


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(COUNTERS, np.uint64)
        for batch in batches:
            held, n = [], 0
            for _, u in _sets(batch["text"], size):
                held.append(u & np.uint64(COUNTERS - 1))
                n += len(u)
                if n > 1 << 18:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
        blocks = range(COUNTERS // BLOCK)
        yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "counts": pa.array([total[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in blocks], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(c.as_buffer(), np.uint64)
        yield pa.RecordBatch.from_pydict({"block": pa.array(total.keys(), pa.int32()), "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())})

    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()  # COUNTERS numbers
    out = np.zeros(COUNTERS, np.uint64)
    for r in rows:
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint64)
    return out


def _prefix_len(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, version, n, d1, d2, grp, prefix, salts): of each row, its set's size and digest, its group, and its prefix, rarest first."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, size))

    def sign(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for _, u in _sets(batch["text"], size):
                n = len(u)
                digest = np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64)
                count = sketch.value[(u & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.argsort(count, kind="stable")[: _prefix_len(n, percent) if n else 0]
                prefix = u[first].view(np.int64)
                grp = np.frombuffer(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), np.int64)[0]
                spread = (count[first] // np.uint64(HOT)).astype(np.int64) + 1
                salts = np.where(spread > 1, grp % spread, -1).astype(np.int32)
                for c, v in zip(cols, (n, digest[0], digest[1], grp, prefix, salts), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "version", "n", "d1", "d2", "grp", "prefix", "salts"])

    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    return d.mapInArrow(sign, "doc_id long, version long, n long, d1 long, d2 long, grp long, prefix array<long>, salts array<int>")


def _shared(signed: DataFrame, percent: int) -> DataFrame:
    """The postings (token, grp, n, pos, band, x_grp, x_n, x_pos) of shingles that are in two groups or more, or that are salted.

    ``band``: the size in steps of the similarity; sizes that may link are a step apart at most. ``x``: the posting that leads
    the shingle's band, the earliest in its prefix. The original of many near copies has no shingles of its own, so that a
    shared one comes early there, and it links with most of them, as a random copy wouldn't.
    """
    p = signed.where("n > 0").select("grp", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("pos", "p"))
    p = p.select(F.col("p.prefix").alias("token"), F.col("p.salts").alias("salt"), "grp", "n", "pos")
    names = ["token", "grp", "n", "pos", "band", "x_grp", "x_n", "x_pos"]
    schema = "token long, grp long, n long, pos int, band int, x_grp long, x_n long, x_pos int"

    def keep(batches):
        held: list[pa.RecordBatch] = []  # of the last shingle, which the next batch may go on with
        for batch in batches:
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            if not len(t):
                continue
            token, salt, grp = (t[c].to_numpy() for c in ("token", "salt", "grp"))
            new = np.flatnonzero((np.diff(token) != 0) | (np.diff(salt) != 0)) + 1
            cut = int(new[-1]) if len(new) else 0
            yield from out(t.slice(0, cut), token[:cut], salt[:cut], grp[:cut], new)
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from out(t, *(t[c].to_numpy() for c in ("token", "salt", "grp")), np.zeros(0, np.int64))

    def out(t, token, salt, grp, new):
        if not len(t):
            return
        starts = np.concatenate([[0], new[new < len(t)]])
        ends = np.concatenate([starts[1:], [len(t)]])
        many = (grp[starts] != grp[ends - 1]) | (salt[starts] >= 0)  # groups are sorted within
        row = np.repeat(many, ends - starts)
        row[1:] &= (np.diff(grp) != 0) | (np.diff(token) != 0) | (np.diff(salt) != 0)  # a group's documents post alike: once
        if not row.any():
            return
        token, salt, grp, n, pos = token[row], salt[row], grp[row], t["n"].to_numpy()[row], t["pos"].to_numpy()[row]
        run = np.concatenate([[0], np.cumsum((np.diff(token) != 0) | (np.diff(salt) != 0))])
        band = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int32)
        order = np.lexsort((grp, pos, band, run))
        first = np.concatenate([[True], (np.diff(run[order]) != 0) | (np.diff(band[order]) != 0)])
        lead = np.empty(len(order), np.int64)
        lead[order] = order[first][np.cumsum(first) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token, grp, n, pos, band, grp[lead], n[lead], pos[lead])], names)

    return p.repartition("token", "salt").sortWithinPartitions("token", "salt", "grp").mapInArrow(keep, schema)


def _few(df: DataFrame) -> DataFrame:
    """The frame, written, to be broadcast if it is small."""
    df = written(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _may_link(a: str, b: str, percent: int) -> str:
    """Of two postings of one shingle, whose columns have these prefixes: sizes within the similarity, and as much of the sets left as it needs."""
    return (
        f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n) AND "
        f"{100 + percent} * least({a}n - {a}pos, {b}n - {b}pos) >= {percent} * ({a}n + {b}n)"
    )


def _filters(pairs: DataFrame) -> tuple[dict[str, np.ndarray], int]:
    """A Bloom filter of each side of the pairs (u, v), of a fixed largest size; made in parts, joined by part."""
    bits = 1 << min(MAX_BLOOM, max(1 << 12, BLOOM_BITS * pairs.count())).bit_length() - 1
    step = 1 << 16
    names, schema = ["side", "at", "bits"], "side string, at long, bits binary"

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names)

    def marks(batches):
        seen = {side: np.zeros(bits // 8, np.uint8) for side in "uv"}
        for batch in batches:
            for side in "uv":
                for p in _places(batch[side].to_numpy(zero_copy_only=False), bits):
                    np.bitwise_or.at(seen[side], p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield rows({(side, i): b for side in "uv" for i in range(0, bits // 8, step) if (b := seen[side][i : i + step]).any()})

    def joined(batches):
        seen: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for side, i, b in zip(batch["side"].to_pylist(), batch["at"].to_pylist(), batch["bits"], strict=True):
                seen[side, i] = seen.get((side, i), 0) | np.frombuffer(b.as_buffer(), np.uint8)
        yield rows(seen)

    out = {side: np.zeros(bits // 8, np.uint8) for side in "uv"}
    for r in pairs.mapInArrow(marks, schema).repartition("side", "at").mapInArrow(joined, schema).toLocalIterator():
        out[r["side"]][r["at"] : r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def _sets_of(bloom: np.ndarray, bits: int, docs: DataFrame, size: int) -> DataFrame:
    """(id, items): the sets of the documents whose ids the filter lets by."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def sets(batches):
        for batch in batches:
            of = batch["doc_id"].to_numpy(zero_copy_only=False)
            ok = np.ones(len(of), bool)
            for p in _places(of, bits):
                ok &= (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            some = batch.filter(pa.array(ok))
            if len(some):
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array([u.tobytes() for _, u in _sets(some["text"], size)], pa.binary())], ["id", "items"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(sets, "id long, items binary")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the stored pairs (u, v) of classes, named by a doc_id of each, those that link, by their whole sets. Few u with many v each move least."""
    filters, bits = _filters(pairs)
    a, b = (_sets_of(filters[k], bits, docs, size).select(F.col("id").alias(k), F.col("items").alias(x)) for k, x in (("u", "a"), ("v", "b")))

    def compare(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for r, (x, y) in enumerate(zip(batch["a"], batch["b"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    # The set of a document with many pairs goes to several tasks, each with some of the pairs.
    parts = _crowded(pairs, ["u"], CENTRE)
    split = pairs.join(F.broadcast(parts), "u", "left").select("u", "v", _salt("v"))
    a = a.join(F.broadcast(parts), "u", "left").select("u", "a", _salts())
    return b.join(_few(split), "v").join(a, ["u", "salt"]).select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def _crowded(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, parts): into how many parts the keys with many of the stored rows go; 50,000 keys at most."""
    limit = max(least, rows.count() // 50_000)
    k = F.count("*").alias("k")
    return written(rows.groupBy(*keys).agg(k).where(F.col("k") > limit).select(*keys, F.ceil(F.col("k") / limit).cast("int").alias("parts")))


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), by), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt")


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = A.mix(ids.astype(np.int64).view(np.uint64))
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def _expanded(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Group pairs (g, h) as the pairs (u, v) of their members; not yet verified."""
    x, y = (classes.select(F.col("grp").alias(k), F.col("cls").alias(c), F.col("comp").alias(f"{c}_comp")) for k, c in (("g", "u"), ("h", "v")))
    p = groups.join(x, "g").join(y, "h").where("u_comp <> v_comp")
    return p.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) of every row of ``docs``.

    A document's set is its distinct shingles of ``size`` words, A-Z lower-cased; fewer words are one shingle. Documents
    link if their sets' Jaccard similarity is ``percent`` or more; component_id is the smallest doc_id that links reach. A
    text that is null or has no words has an empty set and links with nothing. Rows that repeat a doc_id are one document:
    links of either count. A null doc_id links with nothing, and its component is null. An empty table gives an empty one.
    """
    signed = written(signatures(docs.select("doc_id", "text"), size, percent))
    d = signed.select("doc_id", "version", "n", "d1", "d2", "grp")
    full = d.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("n", "d1", "d2", "grp").agg(F.min("doc_id").alias("cls")))
    # An id in several classes ties them.
    mine = written(full.select("doc_id", "n", "d1", "d2").distinct().join(classes, ["n", "d1", "d2"]).select("doc_id", "cls"))
    same = mine.groupBy("doc_id").agg(F.min("cls").alias("u"), F.max("cls").alias("top")).where("u < top")
    ties = mine.join(same, "doc_id").select("u", F.col("cls").alias("v")).where("u <> v")

    members = classes.select("grp", "cls", F.col("cls").alias("comp"))
    post = every = written(_shared(signed.where("doc_id IS NOT NULL"), percent))
    star = post.where("grp <> x_grp").where(_may_link("", "x_", percent))
    star = star.groupBy(F.col("grp").alias("h"), F.col("x_grp").alias("g")).agg(F.count("*").alias("k"))
    star = star.groupBy("h").agg(F.max_by("g", F.struct("k", "g")).alias("g"))
    inner = members.groupBy("grp").agg(F.min("cls").alias("u"))
    first = star.join(inner.withColumnRenamed("grp", "g"), "g").join(members.select(F.col("grp").alias("h"), F.col("cls").alias("v")), "h").select("u", "v")
    first = first.union(members.join(inner, "grp").select("u", F.col("cls").alias("v"))).where("u <> v")
    first = written(first.distinct())
    tried = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = written(_verified(first, docs, size, percent).union(ties))
    comp = components(links)

    members = written(members.drop("comp").join(comp.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    by_group = _few(members.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")))
    post = post.select("token", "grp", "n", "pos", "band").join(by_group, "grp")
    here = post.groupBy("token", "low").agg(F.count("*").alias("k"), F.max("high").alias("high"))
    here = here.groupBy("token").agg(F.max_by("low", F.struct("k", "low")).alias("most"), F.min("low").alias("least"), F.max("high").alias("top")).where("least < top").select("token", "most")
    post = written(post.join(_few(here), "token"))
    discard(every)
    # What isn't in a shingle's largest component, against all that the shingle is in; sizes that may link are in the same band or the next.
    odd = post.where("low <> most OR high <> most").withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    # Postings of a crowded shingle and band are dealt to several tasks, each with all that they are compared with.
    parts = F.broadcast(_crowded(post, ["token", "band"], CROWD))
    y = post.join(parts, ["token", "band"], "left").select(*post.columns, _salt("grp"))
    x = odd.join(parts.withColumnRenamed("band", "near"), ["token", "near"], "left").select(*odd.columns, _salts())
    cross = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.near") == F.col("y.band")) & (F.col("x.salt") == F.col("y.salt")))
    cross = cross.where("x.grp <> y.grp AND (x.low <> y.low OR x.high <> y.high OR x.low <> x.high)").where(_may_link("x.", "y.", percent))
    cross = cross.select(F.least("x.grp", "y.grp").alias("g"), F.greatest("x.grp", "y.grp").alias("h"))
    cross = cross.union(by_group.where("low < high").select(F.col("grp").alias("g"), F.col("grp").alias("h"))).distinct()
    rest = written(_expanded(cross, members).join(tried, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        # What is known of components goes on as one link for each member.
        comp = components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_verified(rest, docs, size, percent)))

    named = mine.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "cls")).alias("component_id"))
    out = d.select("doc_id", "version", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, once. Rows of a null doc_id stay."""
    gone = linked(docs, size, percent).where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    # Of rows that repeat a doc_id the first by text stays; rows without one are each their own.
    lone, row = fresh(docs, "lone", "row")
    kept = kept.withColumn(lone, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    kept = kept.withColumn(row, F.row_number().over(W.partitionBy("doc_id", lone).orderBy("text")))
    return kept.where(F.col(row) == 1).select(*docs.columns)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op6_ngram_join": op6_ngram_join}

ORACLE = {
    "op6_ngram_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANKS}'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
}
