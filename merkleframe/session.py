"""Sessions, input tables and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("merkleframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MERKLEFRAME_DRIVER_MEMORY", "8g"))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only a session on this machine alone, as in tests, may name none; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.get(context.applicationId)
        if base is None:
            base = _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='merkleframe-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The frame, written to the shared folder and read again: short lineage, pruned columns, and safe from lost executors."""
    spark = spark or df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written``; nothing that is yet to run may read it."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if len(os.path.basename(folder)) != 32:
            raise ValueError(f"{folder} isn't a written table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
