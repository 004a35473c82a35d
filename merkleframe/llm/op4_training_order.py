"""Training-order materialisation: token sequences in a keyed random order, in shards of a fixed stride.

Documents are tokenised in the order of the stored input and packed into sequences of LENGTH tokens, an end token after
each document. A sequence is numbered by its input partition and its place in that; a keyed Feistel permutation with
cycle-walking, over all numbers that there may be, takes each number to its place in the training order. How many
sequences there are needn't be known before, so one pass does: places are spread evenly, and equal ranges of them are
equal shards, without sampling or skew. Each range is one partition, sorted by place and streamed into one file. A
sequence's slot is its rank among all, that is its shard's first slot and its number in the shard; sequences are of one
stride, so a reader finds any slot by a division, resumes there, and reads on. Files get their names when they are whole,
so lost executors leave none that is torn.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.llm.arrays import mix
from merkleframe.llm.op5_zip_archives import _store, read_at
from merkleframe.llm.tokens import VOCABULARY, load_vocabulary, tokenizer
from merkleframe.session import scratch, table, written

#: Tokens of a sequence; ids are 16 bits, little endian.
LENGTH = 512
#: Bits of a sequence's number in its partition.
PART_BITS = 32
SEED = 20240229
ROUNDS = 6


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.keys = [int.from_bytes(hashlib.blake2b(f"{seed}:{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left ^ np.uint64(key)) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ np.uint64(key)) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        # The block has less than four times n values; those beyond n are permuted again.
        out = self._once(np.asarray(x, np.uint64), keys, back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, int]:
    """(place, tokens) of every sequence, and the number below which places are.

    A sequence's number is that of its partition and its own in it; its place is where the permutation puts that.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    d = docs.select("text")
    order = Feistel(max(1, d.rdd.getNumPartitions()) << PART_BITS, seed)

    def pack(batches):
        encode, end = tokenizer(sent.value).encode_ordinary, len(sent.value)
        first = TaskContext.get().partitionId() << PART_BITS
        if first >= order.n:
            raise ValueError("the documents have more partitions than they had; write them first")
        held, n, done = [], 0, 0

        def emit(k: int):
            nonlocal held, n, done
            stream = np.concatenate(held)
            cut = np.full(k * length, end, "<u2")
            cut[: min(len(stream), k * length)] = stream[: k * length]
            places = order.slots(np.arange(first + done, first + done + k))
            done += k
            held, n = [stream[k * length :]], max(0, n - k * length)
            return pa.RecordBatch.from_pydict({"place": pa.array(places), "tokens": pa.array([cut[i * length : (i + 1) * length].tobytes() for i in range(k)], pa.binary())})

        for batch in batches:
            for text in batch["text"]:
                if text := text.as_py():
                    held.append(np.array(encode(text), "<u2"))
                    held.append(np.array([end], "<u2"))
                    n += len(held[-2]) + 1
                    if n > 1 << 20:
                        yield emit(n // length)
        if n:
            yield emit(-(-n // length))

    return d.mapInArrow(pack, "place long, tokens binary"), order.n


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = LENGTH, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """(shard, path, first_slot, slots) of the shard files written into ``folder``; ``shards`` of them, or one for each input partition.

    A null or empty text has no tokens and no end token; of ``docs`` only the text is read. The order depends on the input
    files, their split and ``seed`` alone. No documents, no shards.
    """
    s, places = sequences(docs, vocabulary, length, seed)
    shards = shards or places >> PART_BITS
    span = -(-places // shards)

    def write(batches):
        shard = path = out = fs = None
        last = n = 0
        rows = []

        def close():
            out.close()
            fs.move(f"{path}.part", path)
            rows.append((shard, f"{folder}/{_name(shard)}", n))

        for batch in batches:
            for place, tokens in zip(batch["place"].to_pylist(), batch["tokens"], strict=True):
                if place // span != shard:
                    if out is not None:
                        close()
                    shard, n = place // span, 0
                    with _store(f"{folder}/{_name(shard)}") as (fs, path):
                        fs.create_dir(os.path.dirname(path), recursive=True)
                        out = fs.open_output_stream(f"{path}.part")
                elif place <= last:
                    raise ValueError(f"two sequences of place {place}")
                out.write(tokens.as_buffer())
                last, n = place, n + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "path", "slots"])

    s = s.repartitionById(shards, F.expr(f"CAST(place DIV {span}L AS INT)")).sortWithinPartitions("place")
    made = written(s.mapInArrow(write, "shard int, path string, slots long"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    return written(made.select("shard", "path", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("first_slot"), "slots"))


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_shards(shards: DataFrame, from_slot: int = 0, length: int = LENGTH, block: int = 4 << 20) -> DataFrame:
    """(slot, shard, tokens) of all slots from ``from_slot`` on; tokens are 16-bit ids, little endian. Each file is read in sequence, from the first slot wanted."""
    stride = 2 * length

    def read(batches):
        for batch in batches:
            for shard, uri, first, n in zip(*(batch[c].to_pylist() for c in ("shard", "path", "first_slot", "slots")), strict=True):
                with _store(uri) as (fs, path), fs.open_input_file(path) as f:
                    if fs.get_file_info(path).size != n * stride:
                        raise ValueError(f"{uri} isn't of {n} sequences")
                    at = max(0, from_slot - first)
                    while at < n:
                        k = min(max(1, block // stride), n - at)
                        data = read_at(f, at * stride, k * stride)
                        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(first + at, first + at + k), pa.int64()), "shard": pa.array([shard] * k, pa.int32()), "tokens": pa.array([data[i * stride : (i + 1) * stride] for i in range(k)], pa.binary())})
                        at += k

    wanted = shards.where(F.col("first_slot") + F.col("slots") > from_slot)
    # A file for each task; the rows are a few bytes, so that adaptive execution would put them all into one.
    files = (wanted.agg(F.max("shard")).first()[0] or 0) + 1
    return wanted.repartitionById(files, "shard").mapInArrow(read, "slot long, shard int, tokens binary")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), scratch(spark))
    out = read_shards(shards)
    return out.select("slot", "shard", F.sha2("tokens", 256).alias("tokens_sha256"))


QUERIES = {"op4_training_order": op4_training_order}
ORACLE: dict[str, str] = {}
