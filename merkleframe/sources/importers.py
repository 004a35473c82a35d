"""Importers: what lies outside becomes the frames of the model, with a named root.

Each returns ``Frames``; nothing is stored until those are written or published. File contents never pass the driver.
"""

from __future__ import annotations

import hashlib
import io
import os
import stat
import tarfile
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from merkleframe.operators import trees
from merkleframe.session import written

#: The directory without entries: the digest of their number, none.
EMPTY = hashlib.sha256(b"0;").hexdigest()
ENTRIES = "dir string, name string, child string, kind string, size long, executable boolean, target string"


@dataclass(frozen=True)
class Frames:
    """blobs (blob_id, size), entries (ENTRIES) with dir and child as digests, roots (name, target).

    An entry's kind is file, directory or symlink; a symlink has a target and no child.
    """

    blobs: DataFrame
    entries: DataFrame
    roots: DataFrame

    def objects(self) -> DataFrame:
        """(key, payload, payload_size, links) of all blobs and directories; directories link to files and directories, not to symlinks."""
        none = F.array().cast("array<string>")
        blobs = self.blobs.select(F.col("blob_id").alias("key"), F.col("size").alias("payload_size"), none.alias("links"))
        dirs = self.entries.groupBy(F.col("dir").alias("key")).agg(F.count("*").alias("payload_size"), F.collect_set("child").alias("links"))
        bare = self.entries.where("kind = 'directory'").select("child").unionByName(self.roots.select(F.col("target").alias("child"))).where(F.col("child") == EMPTY)
        bare = bare.distinct().select(F.col("child").alias("key"), F.lit(0).cast("long").alias("payload_size"), none.alias("links"))
        return blobs.unionByName(dirs).unionByName(bare).withColumn("payload", F.col("key"))


class Importer(Protocol):
    def to_frames(self, spark: SparkSession) -> Frames: ...


def build_tree(files: DataFrame, roots: dict[str, str] | None, spark: SparkSession) -> Frames:
    """Frames of files (root, path, blob_id, size, and, if there, kind, executable, target): directories are made bottom up, one aggregation for each level.

    ``kind`` is file, directory or symlink; directories need rows only to be there when empty, the top has the empty path.
    Equal directories are one: a directory's id is the digest of its entries. Paths have no empty or dot segments.
    """
    extra = {"kind": F.lit("file"), "executable": F.lit(False), "target": F.lit(None).cast("string")}
    f = files.select("root", "path", "blob_id", F.col("size").cast("long").alias("size"), *(F.coalesce(c, extra[c]).alias(c) if c in files.columns else extra[c].alias(c) for c in extra))
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    f = written(f.withColumn("parts", parts))
    bad = f.where("kind NOT IN ('file', 'directory', 'symlink') OR (kind = 'symlink' AND (target IS NULL OR octet_length(target) NOT BETWEEN 1 AND 4095 OR instr(target, char(0)) > 0))").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: a {bad['kind']} that can't be")
    above = f.where("size(parts) > 0").select("root", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("n"))
    above = written(above.select("root", F.slice("parts", 1, F.col("n")).alias("parts")).distinct())
    clash = f.where("kind <> 'directory'").join(above, ["root", "parts"], "left_semi").first()
    if clash is not None:
        raise ValueError(f"{clash['path']} is a {clash['kind']} and has something below it")
    bare = f.where("kind = 'directory'").join(above, ["root", "parts"], "left_anti").select("root", "parts").distinct()
    columns = ["root", "parts", "child", "kind", "size", "executable", "target"]
    now = f.where("kind = 'file'").withColumn("child", F.col("blob_id")).select(columns)
    now = now.unionByName(f.where("kind = 'symlink'").withColumn("child", F.lit(None).cast("string")).withColumn("size", F.lit(0).cast("long")).withColumn("executable", F.lit(None).cast("boolean")).select(columns))
    directory = [F.lit("directory").alias("kind"), F.lit(None).cast("boolean").alias("executable"), F.lit(None).cast("string").alias("target")]
    now = written(now.unionByName(bare.select("root", "parts", F.lit(EMPTY).alias("child"), F.lit(0).cast("long").alias("size"), *directory).select(columns)))
    depth = now.agg(F.max(F.size("parts"))).first()[0] or 0
    entries, waiting = None, now
    for level in range(depth, 0, -1):
        here = waiting.where(F.size("parts") == level)
        e = here.select("root", F.slice("parts", 1, level - 1).alias("up"), F.element_at("parts", -1).alias("name"), "child", "kind", "size", "executable", "target")
        key = F.to_json(F.struct("root", "up")).alias("dir")
        per = written(e.select("root", "up", key, "name", "child", "kind", "size", "executable", "target"))
        if (twice := trees.duplicate_names(per).first()) is not None:
            raise ValueError(f"{twice['name']} is there twice in {twice['dir']}")
        what = F.when(F.col("executable"), "executable").otherwise(F.col("kind"))
        digest = trees.directory_digests(per.select("dir", "name", F.concat_ws(":", what, "child", "target").alias("child"), "size")).withColumnRenamed("digest", "id")
        # A directory counts all that is below it, itself left out.
        sums = per.groupBy("dir", "root", "up").agg(F.sum(F.when(F.col("kind") == "directory", F.col("size") + 1).otherwise(F.lit(1))).alias("below"))
        made = written(sums.join(digest, "dir"))
        step = written(per.join(made.select("dir", "id"), "dir").select(F.col("id").alias("dir"), "name", "child", "kind", "size", "executable", "target").distinct())
        entries = step if entries is None else entries.unionByName(step)
        up = made.select("root", F.col("up").alias("parts"), F.col("id").alias("child"), F.col("below").alias("size"), *directory)
        waiting = written(waiting.where(F.size("parts") < level).unionByName(up))
    blobs = f.where("kind = 'file'").groupBy("blob_id").agg(F.max("size").alias("size"))
    tops = waiting.where(F.size("parts") == 0).select("root", "child")
    if roots is None:
        named = tops.select(F.lit(None).cast("string").alias("name"), F.col("child").alias("target"))
    else:
        named = tops.join(spark.createDataFrame(list(roots.items()), "root string, name string"), "root").select("name", F.col("child").alias("target"))
    if entries is None:
        entries = spark.createDataFrame([], ENTRIES)
    return Frames(blobs, entries.distinct(), named)


@dataclass(frozen=True)
class FilesystemImport:
    """A directory tree under a root name, or under none."""

    path: str
    root: str | None = None

    def to_frames(self, spark: SparkSession) -> Frames:
        files = read_files(spark, self.path).withColumn("root", F.lit("0"))
        return build_tree(files, {"0": self.root} if self.root else None, spark)


@dataclass(frozen=True)
class MultiRootFilesystemImport:
    """Several trees at once, each under a name of its own."""

    sources: tuple[tuple[str, str], ...]

    def to_frames(self, spark: SparkSession) -> Frames:
        names = [name for _, name in self.sources]
        if len(set(names)) != len(names):
            raise ValueError("a root name is there twice")
        files = None
        for i, (path, _) in enumerate(self.sources):
            f = read_files(spark, path).withColumn("root", F.lit(str(i)))
            files = f if files is None else files.unionByName(f)
        return build_tree(files, {str(i): n for i, n in enumerate(names)}, spark)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, blob_id, size, kind, executable, target) of all that is below a folder, the folder itself included.

    A folder of a mounted file system, shared as Spark's own file: paths are, has symlinks, modes and empty folders; it is
    listed level by level, folders dealt to tasks, and its files are read in pieces. Other stores have files only, read by the
    binary file source.
    """
    base = path.rstrip("/")
    if base.startswith(("/", "file:")):
        return _read_mounted(spark, "/" + base.removeprefix("file:").lstrip("/"))
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    tail = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    root = base.split(":", 1)[1] if ":" in base.split("/", 1)[0] else base
    inner = tail.substr(F.lit(len("/" + root.strip("/")) + 2), F.length("path"))
    plain = [F.lit("file").alias("kind"), F.lit(False).alias("executable"), F.lit(None).cast("string").alias("target")]
    return f.select(inner.alias("path"), F.sha2("content", 256).alias("blob_id"), F.col("length").alias("size"), *plain)


def _read_mounted(spark: SparkSession, base: str) -> DataFrame:
    import pyarrow as pa

    listed = "path string, kind string, executable boolean, target string"

    def listing(batches):
        for batch in batches:
            for folder in batch["path"].to_pylist():
                rows = []
                with os.scandir(os.path.join(base, folder)) as found:
                    for e in found:
                        name = f"{folder}/{e.name}" if folder else e.name
                        if e.is_symlink():
                            rows.append((name, "symlink", None, os.readlink(e.path)))
                        elif e.is_dir():
                            rows.append((name, "directory", None, None))
                        elif e.is_file():
                            rows.append((name, "file", bool(e.stat().st_mode & (stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)), None))
                        else:
                            raise ValueError(f"{name} is of a kind that isn't imported")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))], ["path", "kind", "executable", "target"])

    def digests(batches):
        for batch in batches:
            ids, sizes = [], []
            for name in batch["path"].to_pylist():
                with open(os.path.join(base, name), "rb") as f:
                    ids.append(hashlib.file_digest(f, "sha256").hexdigest())
                    sizes.append(f.tell())
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), batch["kind"], batch["executable"], batch["target"]], ["path", "blob_id", "size", "kind", "executable", "target"])

    # Counts are explicit: a folder's name is a small row, and many of them would be put into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.createDataFrame([("", "directory", None, None)], listed)
    everything, now = top, top.select("path")
    while True:
        step = written(now.repartition(tasks, "path").mapInArrow(listing, listed))
        everything = everything.unionByName(step)
        now = step.where("kind = 'directory'").select("path")
        if now.isEmpty():
            break
    files = everything.where("kind = 'file'").repartition(tasks, "path").mapInArrow(digests, f"path string, blob_id string, size long, {listed.split(', ', 1)[1]}")
    rest = everything.where("kind <> 'file'").select("path", F.lit(None).cast("string").alias("blob_id"), F.lit(0).cast("long").alias("size"), "kind", "executable", "target")
    return files.unionByName(rest)


@dataclass(frozen=True)
class BlobImport:
    """Each row of a text column as a blob under a root of its own."""

    rows: DataFrame
    name: str
    text: str

    def to_frames(self, spark: SparkSession) -> Frames:
        b = self.rows.select(F.col(self.name).cast("string").alias("name"), F.sha2(self.text, 256).alias("blob_id"), F.octet_length(self.text).cast("long").alias("size"))
        none = spark.createDataFrame([], ENTRIES)
        return Frames(b.select("blob_id", "size").distinct(), none, b.select("name", F.col("blob_id").alias("target")))


class TarError(ValueError):
    pass


def canonical(path: str) -> str | None:
    """A member's path without dots and slashes too many; null for the top itself; leaving the archive is an error."""
    if path.startswith("/"):
        raise TarError(f"an absolute path: {path}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise TarError(f"a path that leaves the archive: {path}")
    return "/".join(parts) or None


class TarSource(DataSource):
    """``spark.read.format("tarball").load(path)``: a row for each member; one partition for each archive, of several paths comma-joined."""

    @classmethod
    def name(cls) -> str:
        return "tarball"

    def schema(self) -> str:
        return "archive string, path string, kind string, size long, executable boolean, target string, content binary"

    def reader(self, schema):
        return _TarReader(self.options["path"].split(","))


class _Archive(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _TarReader(DataSourceReader):
    def __init__(self, uris: list[str]):
        self.uris = uris

    def partitions(self):
        return [_Archive(u) for u in self.uris]

    def read(self, partition):
        from pyarrow import fs

        uri = partition.uri
        store, path = (fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith(("/", "file:")) else fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f, tarfile.open(fileobj=io.BufferedReader(f, 1 << 16) if hasattr(f, "readinto") else f, mode="r|*") as t:
            for m in t:
                name = canonical(m.name)
                if name is None:
                    continue
                if m.isdir():
                    yield uri, name, "directory", 0, False, None, None
                elif m.issym():
                    yield uri, name, "symlink", 0, False, m.linkname, None
                elif m.islnk():
                    yield uri, name, "hardlink", 0, False, canonical(m.linkname), None
                elif m.isreg():
                    data = t.extractfile(m).read()
                    yield uri, name, "file", len(data), bool(m.mode & 0o111), None, data
                else:
                    raise TarError(f"{m.name} is of a kind that isn't imported")


@dataclass(frozen=True)
class TarImport:
    """A tar archive's files, folders and symlinks under a root name; hard links are what they link to."""

    path: str
    root: str

    def to_frames(self, spark: SparkSession) -> Frames:
        spark.dataSource.register(TarSource)
        m = written(spark.read.format("tarball").load(self.path))
        last = m.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").first()
        if last is not None:
            raise TarError(f"{last['path']} is there twice")
        own = m.where("kind IN ('file', 'symlink')").select("path", F.sha2("content", 256).alias("blob_id"), "size", "kind", "executable", F.col("target").alias("aim"))
        links = m.where("kind IN ('file', 'hardlink', 'symlink')").select(F.col("path").alias("id"), F.when(F.col("kind") == "hardlink", F.col("target")).alias("link"))
        to = written(trees.resolve_hardlinks(links))
        if (bad := to.where("error IS NOT NULL").first()) is not None:
            raise TarError(f"{bad['id']}: {bad['error']} hard link")
        f = to.select(F.col("id").alias("path"), "target").join(own.withColumnRenamed("path", "target"), "target").select("path", "blob_id", "size", "kind", "executable", F.col("aim").alias("target"))
        none = F.lit(None).cast("string")
        f = f.unionByName(m.where("kind = 'directory'").select("path", none.alias("blob_id"), "size", "kind", "executable", none.alias("target")))
        top = spark.createDataFrame([("", None, 0, "directory", None, None)], f.schema)
        return build_tree(f.unionByName(top).withColumn("root", F.lit("0")), {"0": self.root}, spark)


@dataclass(frozen=True)
class NarImport:
    """A NAR stream's tree under a root name. A lone file or symlink, which has no name there, is named "content"."""

    path: str
    root: str

    def to_frames(self, spark: SparkSession) -> Frames:
        import pyarrow as pa

        from merkleframe.sources.nar import unpack

        def parse(batches):
            for batch in batches:
                rows = [row for data in batch["content"].to_pylist() for row in unpack(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["path", "node", "content"])

        raw = spark.read.format("binaryFile").load(self.path).select("content").mapInArrow(parse, "path string, node string, content binary")
        regular = F.col("node").isin("file", "executable")
        f = raw.select(
            F.when((F.col("path") == "") & (F.col("node") != "directory"), "content").otherwise(F.col("path")).alias("path"),
            F.when(regular, F.sha2("content", 256)).alias("blob_id"), F.when(regular, F.octet_length("content")).otherwise(0).alias("size"),
            F.when(regular, "file").otherwise(F.col("node")).alias("kind"), (F.col("node") == "executable").alias("executable"),
            F.when(F.col("node") == "symlink", F.col("content").cast("string")).alias("target"),
        )
        return build_tree(f.withColumn("root", F.lit("0")), {"0": self.root}, spark)


@dataclass(frozen=True)
class BundleImport:
    """An exported bundle, all or nothing: what its records name must be there, and nothing else."""

    path: str

    def to_frames(self, spark: SparkSession) -> Frames:
        from merkleframe.sources.bundle import PAYLOAD, ROOT, BundleError, membership

        wrong = membership(spark, self.path).first()
        if wrong is not None:
            raise BundleError(f"{wrong['side']}: {wrong['key']}")
        b = spark.read.parquet(self.path)
        none = spark.createDataFrame([], ENTRIES)
        blobs = b.where(f"section = {PAYLOAD}").select(F.col("id").alias("blob_id"), F.octet_length("body").cast("long").alias("size"))
        return Frames(blobs, none, b.where(f"section = {ROOT}").select(F.col("id").alias("name"), F.col("body").cast("string").alias("target")))


def detect(path: str) -> str:
    """The importer that a local path asks for, by its shape and first bytes."""
    from merkleframe.sources.bundle import MAGIC

    if os.path.isdir(path):
        return "git" if os.path.isdir(os.path.join(path, ".git")) or os.path.isfile(os.path.join(path, "HEAD")) and os.path.isdir(os.path.join(path, "objects")) else "filesystem"
    with open(path, "rb") as f:
        head = f.read(1024)
    if head.startswith(MAGIC):
        return "bundle"
    if head[257:262] == b"ustar":
        return "tar"
    if head[8:21] == b"nix-archive-1":
        return "nar"
    raise ValueError(f"no importer is known for {path}")
