"""A repository on a shared file system: immutable snapshots of Parquet tables, and numbered pointers of which the last is current.

A snapshot is a folder; publishing writes a new one, and then the pointer of the next generation, which comes to be whole and
only if it isn't there. So of several publications made on one revision the first wins, the others fail and leave nothing,
and a crash leaves the repository as it was. Pointers, some 70 bytes each, are never deleted or changed. This needs a file
system whose rename is atomic and replaces no file, as HDFS's is; local files are linked. Readers hold a snapshot by its path;
collection leaves held ones alone.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.operators import graph

OBJECTS = "key string, payload string, payload_size long, links array<string>, created_generation long, validated boolean"
ROOTS = "name string, target string"
POLICY = "name string, last_use long"


class RevisionChanged(Exception):
    """Another publication came first."""


class ImmutableConflict(Exception):
    """A key was published again with another record."""


class IncompleteClosure(Exception):
    """A root was to name an object that isn't all there."""


class Conflict(Exception):
    """A check didn't hold; ``index`` is the first that didn't."""

    def __init__(self, index: int):
        super().__init__(f"check {index} doesn't hold")
        self.index = index


@dataclass(frozen=True)
class Snapshot:
    """One revision: its tables don't change."""

    spark: SparkSession
    path: str
    revision: str
    generation: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema({"objects": OBJECTS, "roots": ROOTS, "policy": POLICY}[name]).parquet(f"{self.path}/{name}")

    objects = property(lambda self: self.table("objects"))
    roots = property(lambda self: self.table("roots"))
    policy = property(lambda self: self.table("policy"))

    def links(self) -> DataFrame:
        return self.objects.select(F.col("key").alias("src"), F.explode("links").alias("dst"))

    def live(self) -> DataFrame:
        """Keys that the named roots reach. A target without a record is corruption."""
        seen = graph.reach(self.roots.select(F.col("target").alias("key")), self.links())
        gap = seen.join(self.objects, "key", "left_anti").first()
        if gap is not None:
            raise IncompleteClosure(f"{gap['key']} is reached and has no record")
        return seen


@dataclass
class Session:
    """Staged changes on a snapshot; nothing shows until they are published."""

    base: Snapshot
    staged: list[DataFrame] = field(default_factory=list)
    set_roots: dict[str, str] = field(default_factory=dict)
    removed_roots: list[str] = field(default_factory=list)
    removed_prefixes: list[str] = field(default_factory=list)
    policies: dict[str, int | None] = field(default_factory=dict)

    def stage(self, objects: DataFrame) -> None:
        """Objects (key, payload, payload_size, links); links are stored sorted, each once."""
        self.staged.append(objects.select("key", "payload", F.col("payload_size").cast("long").alias("payload_size"), F.array_sort(F.array_distinct("links")).alias("links")))

    def set_root(self, name: str, target: str) -> None:
        self.set_roots[name] = target

    def remove_root(self, name: str) -> None:
        self.removed_roots.append(name)

    def remove_roots_under(self, prefix: str) -> None:
        self.removed_prefixes.append(prefix)

    def set_retention(self, name: str, last_use: int | None) -> None:
        """Evictable since a time, or permanent for null."""
        self.policies[name] = last_use


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._p = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._holds: set[str] = set()
        self._fs.mkdirs(self._p(f"{self.path}/pointers"))
        if self._last() is None:
            try:
                self._write({"objects": self._empty(OBJECTS), "roots": self._empty(ROOTS), "policy": self._empty(POLICY)}, 0)
            except RevisionChanged:
                pass  # another session set it up

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _write(self, tables: dict[str, DataFrame], generation: int) -> Snapshot:
        revision = uuid.uuid4().hex
        path = f"{self.path}/snapshots/{revision}"
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}")
        # The pointer is written aside, and gets its name if no other publication has that yet.
        side = self._p(f"{self.path}/pointers/.{revision}")
        out = self._fs.create(side, True)
        out.write(bytearray(json.dumps({"revision": revision, "generation": generation}).encode()))
        out.close()
        if not self._named(side, self._p(f"{self.path}/pointers/{generation:020d}")):
            self._fs.delete(side, False)
            self._fs.delete(self._p(path), True)
            raise RevisionChanged(f"generation {generation} was published meanwhile")
        return Snapshot(self.spark, path, revision, generation)

    def _named(self, side, target) -> bool:
        """Gives the pointer its name, unless a file of that name is there."""
        if self._fs.getUri().getScheme() != "file":
            return not self._fs.exists(target) and self._fs.rename(side, target)
        try:
            os.link(side.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        self._fs.delete(side, False)
        return True

    def _last(self) -> str | None:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/pointers"))]
        return max((n for n in names if n.isdigit()), default=None)

    def snapshot(self) -> Snapshot:
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/pointers/{self._last()}").collect())
        now = json.loads(text)
        return Snapshot(self.spark, f"{self.path}/snapshots/{now['revision']}", now["revision"], now["generation"])

    def hold(self) -> Snapshot:
        """A snapshot that vacuum leaves in place until released."""
        s = self.snapshot()
        self._holds.add(s.revision)
        return s

    def release(self, s: Snapshot) -> None:
        self._holds.discard(s.revision)

    def session(self) -> Session:
        return Session(self.snapshot())

    def publish(self, session: Session, at_revision: bool = True, expect_roots: dict[str, str | None] | None = None) -> Snapshot:
        """All of a session's changes, or none.

        Equal records that are there already keep their generation; a key with another record is a conflict. Roots are
        compared with what is expected, null for none, before anything is written; a new root's closure must be complete.
        Setting a root refreshes its retention if it has one; removing it removes that too.
        """
        base = self.snapshot()
        if at_revision and base.revision != session.base.revision:
            raise RevisionChanged(f"{session.base.revision} isn't current")
        roots = {r["name"]: r["target"] for r in base.roots.where(F.col("name").isin([*(expect_roots or {}), ""])).collect()}
        for i, (name, target) in enumerate((expect_roots or {}).items()):
            if roots.get(name) != target:
                raise Conflict(i)
        objects = base.objects
        generation = base.generation + 1
        if session.staged:
            staged = session.staged[0]
            for more in session.staged[1:]:
                staged = staged.unionByName(more)
            staged = staged.distinct()
            twice = staged.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").first()
            old = objects.select("key", *(F.col(c).alias(f"_{c}") for c in ("payload", "payload_size", "links")))
            same = F.col("payload").eqNullSafe(F.col("_payload")) & F.col("payload_size").eqNullSafe(F.col("_payload_size")) & F.col("links").eqNullSafe(F.col("_links"))
            other = staged.join(old, "key").where(~same).first()
            if twice is not None or other is not None:
                raise ImmutableConflict((twice or other)["key"])
            new = staged.join(objects.select("key"), "key", "left_anti")
            objects = objects.unionByName(new.withColumn("created_generation", F.lit(generation).cast("long")).withColumn("validated", F.lit(False)))
        kept = base.roots.where(~F.col("name").isin([*session.set_roots, *session.removed_roots, ""]))
        for prefix in session.removed_prefixes:
            kept = kept.where((F.col("name") != prefix) & ~F.col("name").startswith(f"{prefix}/"))
        if session.set_roots:
            named = self.spark.createDataFrame(list(session.set_roots.items()), ROOTS)
            links = objects.select(F.col("key").alias("src"), F.explode("links").alias("dst"))
            closure = graph.reach(named.select(F.col("target").alias("key")), links)
            gap = closure.join(objects.select("key"), "key", "left_anti").first()
            if gap is not None:
                raise IncompleteClosure(gap["key"])
            good = closure.select("key", F.lit(True).alias("_good"))
            objects = objects.join(good, "key", "left").withColumn("validated", F.coalesce("_good", "validated")).drop("_good")
            kept = kept.unionByName(named)
        policy = base.policy.join(kept.select("name"), "name", "left_semi").where(~F.col("name").isin([*session.policies, ""]))
        if session.set_roots:
            touched = F.col("name").isin(list(session.set_roots))
            policy = policy.withColumn("last_use", F.when(touched, F.greatest("last_use", F.unix_micros(F.current_timestamp()) * 1000)).otherwise(F.col("last_use")))
        if rows := [(n, t) for n, t in session.policies.items() if t is not None]:
            policy = policy.unionByName(self.spark.createDataFrame(rows, POLICY))
        return self._write({"objects": objects, "roots": kept, "policy": policy}, generation)

    def evict_next_root(self) -> str | None:
        """Removes the evictable root that was used the longest ago; names break ties."""
        last = self.snapshot().policy.orderBy("last_use", "name").first()
        if last is None:
            return None
        s = self.session()
        s.remove_root(last["name"])
        self.publish(s)
        return last["name"]

    def collect(self, pins: DataFrame | None = None) -> tuple[Snapshot, int]:
        """Drops records that neither roots nor pins (key) reach; absent pins are let be. The new snapshot, and how many went."""
        base = self.snapshot()
        live = base.live().select("key")
        if pins is not None:
            known = pins.select("key").join(base.objects.select("key"), "key", "left_semi")
            inner = base.links().join(base.objects.select(F.col("key").alias("dst")), "dst", "left_semi")
            live = live.union(graph.reach(known, inner).select("key")).distinct()
        kept = base.objects.join(live, "key", "left_semi")
        before = base.objects.count()
        out = self._write({"objects": kept, "roots": base.roots, "policy": base.policy}, base.generation + 1)
        return out, before - out.objects.count()

    def vacuum(self, abandoned: float = 7 * 24 * 3600) -> int:
        """Deletes published snapshot folders that are neither current nor held; how many went.

        A folder that no pointer names may be a publication under way: it goes once it is ``abandoned`` seconds old.
        """
        keep = {self.snapshot().revision, *self._holds}
        folders = {s.getPath().getName(): s for s in self._fs.listStatus(self._p(f"{self.path}/snapshots"))}
        pointers = self.spark.read.schema("revision string").json(f"{self.path}/pointers")
        published = {r.revision for r in pointers.where(F.col("revision").isin([*folders, ""])).collect()}  # as many as there are folders
        gone = 0
        for name, status in folders.items():
            if name in keep or name not in published and status.getModificationTime() / 1000 > time.time() - abandoned:
                continue
            self._fs.delete(status.getPath(), True)
            gone += 1
        return gone
