"""Blob stores: one contract, several backends, and stores made of two."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "blob_id string, content binary"


class BlobStore(Protocol):
    """Frames in, frames out; ``put`` keeps what is there and returns how many were new."""

    def blobs(self) -> DataFrame: ...

    def put(self, blobs: DataFrame) -> int: ...


class ParquetStore:
    """Blobs in any file system that Spark writes, partitioned by the first hex digit: a lookup by id reads one part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def blobs(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{SCHEMA}, prefix string").parquet(self.path).select("blob_id", "content")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def put(self, blobs: DataFrame) -> int:
        new = missing(blobs.dropDuplicates(["blob_id"]), self.blobs(), "blob_id").withColumn("prefix", F.substring("blob_id", 1, 1))
        before = self.blobs().count()
        new.write.mode("append").partitionBy("prefix").parquet(self.path)
        return self.blobs().count() - before

    def get(self, ids: list[str]) -> DataFrame:
        """A few blobs; the partition filter reaches the scan."""
        rows = self.spark.read.schema(f"{SCHEMA}, prefix string").parquet(self.path)
        return rows.where(F.col("prefix").isin([i[:1] for i in ids]) & F.col("blob_id").isin(ids)).select("blob_id", "content")


class MemoryStore:
    """Blobs as a frame of the session."""

    def __init__(self, spark: SparkSession):
        self.frame = spark.createDataFrame([], SCHEMA)

    def blobs(self) -> DataFrame:
        return self.frame

    def put(self, blobs: DataFrame) -> int:
        new = missing(blobs.dropDuplicates(["blob_id"]), self.frame, "blob_id").select("blob_id", "content").persist()
        self.frame = self.frame.unionByName(new)
        return new.count()


class TieredStore:
    """Reads near, then far; writes near."""

    def __init__(self, near: BlobStore, far: BlobStore):
        self.near, self.far = near, far

    def blobs(self) -> DataFrame:
        near = self.near.blobs()
        return near.unionByName(missing(self.far.blobs(), near, "blob_id"))

    def put(self, blobs: DataFrame) -> int:
        return self.near.put(missing(blobs, self.far.blobs(), "blob_id"))


class RepairingStore:
    """Near, but for rows that aren't what their id says: those come from far, if they are right there, and else not at all."""

    def __init__(self, near: BlobStore, far: BlobStore):
        self.near, self.far = near, far

    def blobs(self) -> DataFrame:
        good = lambda df: df.where(F.sha2("content", 256) == F.col("blob_id"))
        near = good(self.near.blobs())
        bad = self.near.blobs().select("blob_id").join(near.select("blob_id"), "blob_id", "left_anti")
        return near.unionByName(good(self.far.blobs()).join(bad, "blob_id", "left_semi"))

    def put(self, blobs: DataFrame) -> int:
        return self.near.put(blobs)


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return wanted.join(held.select(key), key, "left_anti")


def has_batch(store: BlobStore, ids: DataFrame) -> DataFrame:
    """Ids (ordinal, blob_id) with ``present``; every request is answered."""
    held = store.blobs().select("blob_id").distinct().withColumn("_held", F.lit(True))
    return ids.join(held, "blob_id", "left").select("ordinal", "blob_id", F.coalesce("_held", F.lit(False)).alias("present"))
