"""Archive bundles: a stream of frames, payloads before the records that need them, each once, in canonical order."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"MFBUNDLE\x01"
ROOT, PAYLOAD, RECORD, END = 1, 2, 3, 4


class BundleError(ValueError):
    pass


def write(out: BinaryIO, roots: Iterable[tuple[str, str]], payloads: Iterable[tuple[str, bytes]], records: Iterable[tuple[str, bytes]]) -> dict[str, int]:
    """A bundle of sorted (key, bytes); counts by kind."""
    counts = {"roots": 0, "payloads": 0, "records": 0}
    out.write(MAGIC)
    for kind, name, rows in ((ROOT, "roots", ((k, v.encode()) for k, v in roots)), (PAYLOAD, "payloads", payloads), (RECORD, "records", records)):
        last = None
        for key, body in rows:
            if last is not None and key <= last:
                raise BundleError(f"{key} is out of order or there twice")
            last = key
            raw = key.encode()
            out.write(struct.pack("<BQQ", kind, len(raw), len(body)) + raw + body)
            counts[name] += 1
    out.write(struct.pack("<BQQ", END, 0, 0))
    return counts


def read(data: BinaryIO) -> Iterator[tuple[int, str, bytes]]:
    """(kind, key, body) of a bundle's frames; kinds out of order, keys out of order or twice, and a stream that is cut are errors."""

    def take(n: int) -> bytes:
        b = data.read(n)
        if len(b) != n:
            raise BundleError("truncated")
        return b

    if take(len(MAGIC)) != MAGIC:
        raise BundleError("not a bundle")
    last = (0, "")
    while True:
        kind, n_key, n_body = struct.unpack("<BQQ", take(17))
        if kind == END:
            if n_key or n_body or data.read(1):
                raise BundleError("something follows the end")
            return
        if kind not in (ROOT, PAYLOAD, RECORD) or n_key > 4096:
            raise BundleError("an unknown frame")
        key = take(n_key).decode()
        if (kind, key) <= last:
            raise BundleError("frames out of order")
        last = kind, key
        yield kind, key, take(n_body)


def export(plan: DataFrame, path: str) -> None:
    """A bundle too large for one stream: frames (section, id, body) as Parquet, range-partitioned in their order."""
    plan.repartitionByRange("section", "id").sortWithinPartitions("section", "id").write.parquet(path)


def membership(spark: SparkSession, path: str) -> DataFrame:
    """(side, key) of what an exported bundle lacks or has too much: payloads against those that its records name."""
    b = spark.read.parquet(path)
    have = b.where(f"section = {PAYLOAD}").select(F.col("id").alias("key"))
    want = b.where(f"section = {RECORD}").select(F.col("body").cast("string").alias("key")).distinct()
    return want.join(have, "key", "left_anti").select(F.lit("missing").alias("side"), "key").union(have.join(want, "key", "left_anti").select(F.lit("extra"), "key"))
