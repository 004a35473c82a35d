"""Incremental state: a log consumed by Structured Streaming into a table of the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.operators.metadata import latest
from merkleframe.session import scratch


class StateLog:
    """Deltas by epoch, and every so many of them a checkpoint that stands for all before it.

    A batch that is run again after a loss writes the same delta to the same place, so state is exact; and as a read takes
    the newest row of each key, a delta that is met twice does no harm.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: str, values: list[str], checkpoint_every: int = 9):
        self.spark, self.root, self.keys, self.order, self.every = spark, root.rstrip("/"), keys, order, checkpoint_every
        self.columns = [*keys, *values, order]

    def _epochs(self, kind: str) -> list[int]:
        """Epochs that are written whole."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = (s.getPath() for s in fs.listStatus(path))
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        self._newest(batch).write.mode("overwrite").parquet(f"{self.root}/delta/epoch={epoch}")
        if (epoch + 1) % self.every == 0:
            self.read(epoch).write.mode("overwrite").parquet(f"{self.root}/checkpoint/epoch={epoch}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest(rows.select(*self.columns), self.keys, [self.order]).select(*self.columns)

    def read(self, upto: int | None = None) -> DataFrame | None:
        """State after an epoch, or now: the last checkpoint before it and the deltas since."""
        deltas = [e for e in self._epochs("delta") if upto is None or e <= upto]
        if not deltas:
            return None
        base = max((e for e in self._epochs("checkpoint") if e < (deltas[-1] + 1 if upto is None else upto)), default=-1)
        paths = [f"{self.root}/delta/epoch={e}" for e in deltas if e > base] + ([f"{self.root}/checkpoint/epoch={base}"] if base >= 0 else [])
        return self._newest(self.spark.read.parquet(*paths))

    def prune(self) -> int:
        """Deletes deltas and checkpoints that the last checkpoint stands for; how many."""
        last = max(self._epochs("checkpoint"), default=-1)
        hadoop, gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs, 0
        for kind, old in (("delta", lambda e: e <= last), ("checkpoint", lambda e: e < last)):
            for e in filter(old, self._epochs(kind)):
                path = hadoop.Path(f"{self.root}/{kind}/epoch={e}")
                gone += path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return gone


def follow(log: StateLog, path: str, files_per_batch: int = 4) -> None:
    """Takes in what is new of the Parquet log at ``path``, a file or a folder, and ends."""
    spark = log.spark
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    parent, _, name = path.rstrip("/").rpartition("/")
    # A single file is followed through its folder.
    source = stream.option("pathGlobFilter", name).parquet(parent) if _is_file(spark, path) else stream.parquet(path)
    source.writeStream.foreachBatch(log.upsert).option("checkpointLocation", f"{log.root}/log").trigger(availableNow=True).start().awaitTermination()


def latest_state(spark: SparkSession, path: str, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """(keys, values, order): the state of the whole log at ``path``."""
    log = StateLog(spark, scratch(spark), keys, order, values)
    follow(log, path)
    return log.read()


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts by event-time window of a stream, rows later than ``late`` left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
