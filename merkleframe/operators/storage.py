"""Chunks, manifests, packs, tiers and proofs, as operations on frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.session import written


def fixed_chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, ordinal, chunk): texts in chunks of ``size`` characters, cut in one pass; an empty text is one empty chunk, a null one a null."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    chunks = F.when(F.col("text").isNull(), F.array(F.lit(None).cast("string"))).when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)
    return docs.select("doc_id", F.posexplode(chunks).alias("ordinal", "chunk"))


def manifest(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id, size and offset, in bytes, to (doc_id, ordinal, chunk)."""
    ahead = W.partitionBy("doc_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    c = chunks.select("doc_id", "ordinal", "chunk", F.octet_length("chunk").cast("long").alias("size"), F.sha2("chunk", 256).alias("chunk_id"))
    return c.withColumn("offset", F.coalesce(F.sum("size").over(ahead), F.lit(0)).cast("long"))


def covering(m: DataFrame, offset: int, length: int) -> DataFrame:
    """The chunks that overlap the bytes from ``offset``, and the part of each: ``from`` and ``to``."""
    end = F.col("offset") + F.col("size")
    hit = m.where((F.col("offset") < offset + length) & (end > offset))
    return hit.select("*", F.greatest("offset", F.lit(offset)).cast("long").alias("from"), F.least(end, F.lit(offset + length)).cast("long").alias("to"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """(doc_id, content): the chunks of each document, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda c: c["chunk"]), "").alias("content"))


def overwrite(chunks: DataFrame, at: int, text: str, size: int) -> DataFrame:
    """Chunks after ``text`` has been written over the characters from ``at``, where a document is that long; ``changed`` marks those touched."""
    first, last = at // size, (at + len(text) - 1) // size
    base = F.col("ordinal") * size
    from_ = F.greatest(F.lit(at) - base, F.lit(0))
    to = F.least(F.lit(at + len(text)) - base, F.lit(size))
    piece = F.lit(text).substr(F.greatest(base - at, F.lit(0)) + 1, to - from_)
    n = F.max("ordinal").over(W.partitionBy("doc_id"))
    c = chunks.withColumn("_last", n).withColumn("_len", F.char_length("chunk"))
    # The document reaches past ``at``: it has a later chunk, or its own one does.
    holder = F.max(F.when(F.col("ordinal") == first, F.col("_len") > at % size)).over(W.partitionBy("doc_id"))
    c = c.withColumn("_hit", F.coalesce(holder, F.lit(False)))
    after = F.when((F.col("_last") == F.col("ordinal")) & (F.col("_len") < to), F.lit("")).otherwise(F.expr("chunk").substr(to + 1, F.lit(size)))
    # What the text writes past the last chunk's end lengthens it.
    touched = F.col("_hit") & F.col("ordinal").between(first, last)
    new = F.concat(F.col("chunk").substr(F.lit(1), from_), piece, after)
    return c.select("doc_id", "ordinal", F.when(touched, new).otherwise(F.col("chunk")).alias("chunk"), touched.alias("changed"))


def pack_offsets(entries: DataFrame, pack: str, order: str) -> DataFrame:
    """Entries with the offset at which each lies in its pack."""
    ahead = W.partitionBy(pack).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum("size").over(ahead), F.lit(0)).cast("long"))


def greedy_packs(entries: DataFrame, target: int) -> DataFrame:
    """Entries (source, doc_id, size, ..) with their pack: packs are filled in order until they hold ``target`` bytes or more.

    Sequential by its nature: each source's entries are streamed, sorted, with a counter for state; nothing is gathered.
    """

    def fill(batches):
        source, pack, filled = None, 0, 0
        for batch in batches:
            out = []
            for s, n in zip(batch["source"].to_pylist(), batch["size"].to_pylist(), strict=True):
                if s != source:
                    source, pack, filled = s, 0, 0
                elif filled >= target:
                    pack, filled = pack + 1, 0
                filled += n
                out.append(pack)
            yield batch.append_column("pack", pa.array(out, pa.int32()))

    return entries.repartition("source").sortWithinPartitions("source", "doc_id").mapInArrow(fill, ", ".join(f"{c} {t}" for c, t in [*entries.dtypes, ("pack", "int")]))


def seal_packs(packed: DataFrame) -> DataFrame:
    """(source, pack, blobs, bytes, footer, pack_id) of packed entries (source, pack, doc_id, blob_id, size).

    A footer has a line for each blob, in the order in which they lie: id, offset and size. A pack's id is its footer's
    digest. A pack's lines are put together in one row, which the fill's target bounds.
    """
    e = pack_offsets(packed.withColumn("of", F.struct("source", "pack")), "of", "doc_id")
    lines = F.array_sort(F.collect_list(F.struct("doc_id", "offset", F.concat_ws(":", "blob_id", "offset", "size").alias("line"))))
    footer = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return e.groupBy("source", "pack").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"), footer.alias("footer")).withColumn("pack_id", F.sha2("footer", 256))


def footer_index(sealed: DataFrame) -> DataFrame:
    """(pack_id, blob_id, offset, size) read from the footers alone; one that isn't its id's is an error."""
    whole = F.when(F.sha2("footer", 256) == F.col("pack_id"), F.col("footer")).otherwise(F.raise_error(F.concat(F.lit("a footer isn't that of "), "pack_id")))
    part = F.split(F.col("line"), ":")
    return sealed.select("pack_id", F.explode(F.split(whole, "\n")).alias("line")).select("pack_id", part[0].alias("blob_id"), part[1].cast("long").alias("offset"), part[2].cast("long").alias("size"))


def shard_bits(entries: Column, entry_bytes: int, target: int) -> Column:
    """Bits of prefix that make shards of ``target`` bytes, 1 at least."""
    shards = F.greatest(F.ceil(entries * entry_bytes / target), F.lit(1))
    return F.greatest(F.ceil(F.log2(shards)).cast("int"), F.lit(1))


def tiered(near: DataFrame, far: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, tier): near where it has the key, else far."""
    n = near.select(key, F.col(value).alias("_near"))
    f = far.select(key, F.col(value).alias("_far"))
    return n.join(f, key, "full_outer").select(key, F.coalesce("_near", "_far").alias(value), F.when(F.col("_near").isNotNull(), "near").otherwise("far").alias("tier"))


def repair(near: DataFrame, far: DataFrame, key: str) -> DataFrame:
    """What to do with each near row (key, blob_id, text): keep it if its digest matches, repair it from far if that one's does."""
    f = far.select(key, F.col("text").alias("_far"))
    x = near.join(f, key, "left")
    ok = lambda c: F.sha2(c, 256) == F.col("blob_id")
    return x.select(key, F.when(ok("text"), "keep").when(ok("_far"), "repair").otherwise("lost").alias("action"))


def flagged(rows: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a flag for whether ``members`` has their key; every row stays, duplicates too."""
    m = members.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(m, key, "left").select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name))


def insert_flags(batch: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """For each row of a batch, whether inserting it in order would be new to the set."""
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    x = flagged(batch, existing, key, "_there").withColumn("_first", first)
    return x.select(*batch.columns, (F.col("_first") & ~F.col("_there")).alias("inserted"))


def page_by_bytes(rows: DataFrame, order: str, limit: int, max_bytes: int) -> DataFrame:
    """The first rows in order, ``limit`` at most, that together have ``max_bytes`` at most; one row in any case."""
    page = rows.orderBy(order).limit(limit)  # the window is over one page
    w = W.orderBy(order)
    page = page.withColumn("upto", F.sum("size").over(w)).withColumn("_r", F.row_number().over(w))
    return page.where((F.col("upto") <= max_bytes) | (F.col("_r") == 1)).drop("_r")


def merkle_proofs(chunks: DataFrame, leaf: int) -> DataFrame:
    """(doc_id, root, level, sibling): the siblings on the way from a leaf of each document to its root; a last odd node moves up as it is.

    Levels are built bottom up, a join-free aggregation each, over documents that have the leaf.
    """
    now = chunks.select("doc_id", F.col("ordinal").cast("long").alias("i"), F.sha2("chunk", 256).alias("h"))
    has = now.where(F.col("i") == leaf).select("doc_id")
    now = written(now.join(has, "doc_id", "left_semi"))
    at, level, path = leaf, 0, None
    roots = None
    while not now.isEmpty():
        n = now.groupBy("doc_id").agg(F.count("*").alias("n"))
        one = now.join(n.where("n = 1"), "doc_id", "left_semi").select("doc_id", F.col("h").alias("root"))
        roots = one if roots is None else roots.union(one)
        more = now.join(n.where("n > 1"), "doc_id", "left_semi")
        step = more.where(F.col("i") == (at ^ 1)).select("doc_id", F.lit(level).alias("level"), F.col("h").alias("sibling"))
        path = step if path is None else path.union(step)
        pair = F.array_sort(F.collect_list(F.struct("i", "h")))
        now = written(more.groupBy("doc_id", F.floor(F.col("i") / 2).alias("up")).agg(pair.alias("p")).select("doc_id", F.col("up").cast("long").alias("i"), F.when(F.size("p") == 2, F.sha2(F.concat(F.col("p")[0]["h"], F.get("p", F.lit(1))["h"]), 256)).otherwise(F.col("p")[0]["h"]).alias("h")))
        at, level = at // 2, level + 1
    return roots.join(path, "doc_id").select("doc_id", "root", "level", "sibling")


def needle_hits(docs: DataFrame, needles: DataFrame, block: int = 100_000) -> DataFrame:
    """(needle, hits): in how many documents each of the distinct needles occurs whole.

    Needles are broadcast, in blocks of about ``block`` by hash, and each block takes one pass over the documents; matching is
    one automaton, so a pass's cost doesn't grow with the needles. Empty and null needles, and null texts, have no hits.
    """
    needles = written(needles.select("needle").distinct())
    blocks = -(-needles.count() // block) or 1
    found = None
    for i in range(blocks):
        part = needles.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == i)
        n = _needle_hits(docs, [r["needle"] for r in part.where("needle <> ''").collect()])
        found = n if found is None else found.union(n)
    return needles.join(found, "needle", "left").select("needle", F.coalesce("n", F.lit(0)).alias("hits"))


def _needle_hits(docs: DataFrame, needles: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(needles)

    def scan(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle in sent.value:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        found: dict[str, int] = {}
        for batch in batches:
            for text in batch["text"]:
                text = text.as_py()
                for needle in {n for _, n in automaton.iter(text)} if text and len(automaton) else ():
                    found[needle] = found.get(needle, 0) + 1
        yield pa.RecordBatch.from_pydict({"needle": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    return docs.select("text").mapInArrow(scan, "needle string, n long").groupBy("needle").agg(F.sum("n").alias("n"))


def sampled_index(chunks: DataFrame, keep: int) -> DataFrame:
    """(key, doc_id, ordinal): chunks whose digest's first byte is divisible by four, the last ``keep`` of each key."""
    key = F.conv(F.substring("chunk_id", 1, 2), 16, 10).cast("int") % 4 == 0
    last = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("doc_id"), F.desc("ordinal")))
    # row_number with a limit: Spark keeps the first rows of each key before the shuffle too.
    return chunks.where(key).withColumn("_r", last).where(F.col("_r") <= keep).select(F.col("chunk_id").alias("key"), "doc_id", "ordinal")


_GEAR = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)


def _cuts(data: bytes, average: int) -> list[int]:
    """Ends of content-defined chunks: a gear hash of the last 64 bytes, a stricter mask before the average than after it."""
    least, most = average // 2, average * 2
    n = len(data)
    if n <= least:
        return [n] if n else []
    g = _GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(n, np.uint64)
    for k in range(min(32, n)):  # older bytes are shifted out of the bits that the masks look at
        h[k:] += g[: n - k] << np.uint64(k)
    bits = average.bit_length() - 1
    strict, loose = np.uint64((1 << (bits + 1)) - 1 << 16), np.uint64((1 << max(1, bits - 1)) - 1 << 16)
    a, b = np.flatnonzero((h & strict) == 0) + 1, np.flatnonzero((h & loose) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i, j = np.searchsorted(a, at + least), np.searchsorted(b, at + average)
        first = int(a[i]) if i < len(a) and a[i] <= at + average else None
        later = int(b[j]) if j < len(b) else n
        at = first if first is not None else min(later, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def content_chunks(docs: DataFrame, average: int = 1024) -> DataFrame:
    """(doc_id, ordinal, offset, size, chunk_id) of content-defined chunks of (doc_id, text); an empty text has none."""
    import hashlib

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data, at = (text or "").encode(), 0
                for i, end in enumerate(_cuts(data, average)):
                    rows.append((doc_id, i, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "ordinal", "offset", "size", "chunk_id"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, ordinal int, offset long, size long, chunk_id string")


def compressed_sizes(docs: DataFrame, level: int = 3) -> DataFrame:
    """(doc_id, size, compressed_size, ok): each text as a zstd frame, decompressed again within its known size."""

    def pack(batches):
        codec = pa.Codec("zstd", compression_level=level)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = (text or "").encode()
                frame = codec.compress(data, asbytes=True)
                rows.append((doc_id, len(data), len(frame), codec.decompress(frame, len(data), asbytes=True) == data if data else True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "size", "compressed_size", "ok"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, size long, compressed_size long, ok boolean")
