"""Directories, paths and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merkleframe.operators.graph import LimitExceeded
from merkleframe.session import written


def directory_digests(entries: DataFrame) -> DataFrame:
    """(dir, digest) of entries (dir, name, child, size): the hash of the canonical encoding, names in order, each field with its length."""
    framed = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    line = F.concat(framed(F.col("name").cast("string")), framed(F.col("child").cast("string")), framed(F.col("size").cast("string")))
    lines = F.array_sort(F.collect_list(F.struct("name", line.alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return entries.groupBy("dir").agg(F.count("*").alias("n"), joined.alias("body")).select("dir", F.sha2(F.concat(F.col("n").cast("string"), F.lit(";"), "body"), 256).alias("digest"))


def duplicate_names(entries: DataFrame) -> DataFrame:
    """(dir, name, n) of names that a directory has more than once, which it may not."""
    return entries.groupBy("dir", "name").agg(F.count("*").alias("n")).where("n > 1")


def diff(held: DataFrame, wanted: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, change): added, removed or changed entries."""
    h, w = held.select(*on, F.col(value).alias("_h")), wanted.select(*on, F.col(value).alias("_w"))
    j = h.join(w, on, "full_outer")
    change = F.when(F.col("_h").isNull(), "added").when(F.col("_w").isNull(), "removed").when(F.col("_h") != F.col("_w"), "changed")
    return j.select(*on, change.alias("change")).where("change IS NOT NULL")


def url_parts(url: Column) -> Column:
    """Host and path segments of a url, without query or fragment."""
    return F.filter(F.split(F.regexp_replace(F.split_part(url, F.lit("://"), F.lit(2)), "[?#].*$", ""), "/"), lambda s: s != "")


def path_entries(paths: DataFrame) -> DataFrame:
    """(dir, name, child, kind) of the tree that (parts, node) spans: inner directories and the files at its ends. A file that is also a directory is one."""
    p = paths.select("node", F.posexplode("parts").alias("depth", "name"), "parts")
    up = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    last = F.col("depth") == F.size("parts") - 1
    e = p.select(up(F.col("depth")).alias("dir"), "name", up(F.col("depth") + 1).alias("child"), F.when(last, 1).otherwise(0).alias("file"))
    return e.groupBy("dir", "name", "child").agg(F.when(F.min("file") == 1, "file").otherwise("directory").alias("kind"))


def resolve(paths: DataFrame, entries: DataFrame, keep_spine: bool = False) -> DataFrame:
    """(path, found, node) of paths (path, parts) from the root directory "", by one join for each component; or every step's (path, step, name, node)."""
    now = written(paths.select("path", "parts", F.lit("").alias("node"), F.lit(0).alias("step")))
    e = entries.select(F.col("dir").alias("node"), F.col("name").alias("_name"), F.col("child").alias("_child"))
    done, spine = now.where(F.size("parts") == 0).select("path", F.lit(True).alias("found"), "node"), None
    now = now.where(F.size("parts") > 0)
    while not now.isEmpty():
        step = now.withColumn("_name", F.element_at("parts", F.col("step") + 1)).join(e, ["node", "_name"], "left")
        step = written(step.select("path", "parts", F.col("_child").alias("node"), (F.col("step") + 1).alias("step"), F.col("_name").alias("name")))
        hit = step.where("node IS NOT NULL").select("path", "step", "name", "node")
        spine = hit if spine is None else spine.union(hit)
        over = F.col("node").isNull() | (F.col("step") == F.size("parts"))
        done = done.union(step.where(over).select("path", F.col("node").isNotNull(), "node"))
        now = step.where(~over).drop("name")
    return spine if keep_spine else done


def history(commits: DataFrame, wants: DataFrame, haves: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(id, depth, shallow) of the commits (id, parent) that wants reach, without what haves do, ``depth`` commits deep at most.

    A commit whose parent is left out for its depth is shallow. A commit reached at several depths counts by the least.
    """
    links = commits.where("parent IS NOT NULL")
    gone = _reach(haves, links, None).select("id") if haves is not None else None
    got = _reach(wants, links, depth)
    if gone is not None:
        got = got.join(gone, "id", "left_anti")
    cut = links.join(got, "id").where(F.lit(depth is not None) & (F.col("depth") >= (depth or 0))).select("id").distinct().withColumn("cut", F.lit(True))
    return got.join(cut, "id", "left").select("id", "depth", F.coalesce("cut", F.lit(False)).alias("shallow"))


def _reach(seeds: DataFrame, links: DataFrame, depth: int | None) -> DataFrame:
    new, n = written(seeds.select("id").distinct().withColumn("depth", F.lit(1))), 1
    seen = new
    while depth is None or n < depth:
        n += 1
        step = new.select("id").join(links, "id").select(F.col("parent").alias("id")).distinct()
        new = written(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(n)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if n > 1_000_000:
            raise LimitExceeded("a history of over a million generations")
    return seen


def resolve_hardlinks(entries: DataFrame) -> DataFrame:
    """(id, target, rounds, error) of entries (id, link): links followed round by round to an entry that is none; what stays open has no target."""
    files = entries.select(F.col("id").alias("_id"), F.col("link").alias("_link"))
    open_, rounds = written(entries.select("id", F.col("link").alias("at"))), 0
    done = open_.where("at IS NULL").select("id", F.col("id").alias("target"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("error"))
    open_ = open_.where("at IS NOT NULL")
    size = None
    while (n := open_.count()) and n != size:
        size, rounds = n, rounds + 1
        step = written(open_.join(files, open_["at"] == files["_id"], "left"))
        done = done.unionByName(step.where("_id IS NOT NULL AND _link IS NULL").select("id", F.col("_id").alias("target"), F.lit(rounds).alias("rounds"), F.lit(None).cast("string").alias("error")))
        done = done.unionByName(step.where("_id IS NULL").select("id", F.lit(None).cast(dict(entries.dtypes)["id"]).alias("target"), F.lit(rounds).alias("rounds"), F.lit("missing").alias("error")))
        open_ = step.where("_link IS NOT NULL").select("id", F.col("_link").alias("at"))
    return done.unionByName(open_.select("id", F.lit(None).cast(dict(entries.dtypes)["id"]).alias("target"), F.lit(rounds).alias("rounds"), F.lit("cycle").alias("error")))


def line_delta(pairs: DataFrame) -> DataFrame:
    """Delta of each target (id, base, target) against its base, by lines: (id, ordinal, source, literal), copies by the base's line, else the line itself."""
    t = pairs.select("id", F.posexplode(F.split("target", "\n", -1)).alias("ordinal", "line"))
    b = pairs.select("id", F.posexplode(F.split("base", "\n", -1)).alias("at", "line")).groupBy("id", "line").agg(F.min("at").alias("source"))
    j = t.join(b, ["id", "line"], "left")
    return j.select("id", "ordinal", "source", F.when(F.col("source").isNull(), F.col("line")).alias("literal"), F.octet_length("line").cast("long").alias("bytes"))


def apply_line_delta(delta: DataFrame, bases: DataFrame) -> DataFrame:
    """(id, content): what a delta makes of the bases (id, base)."""
    b = bases.select("id", F.posexplode(F.split("base", "\n", -1)).alias("source", "line"))
    j = delta.join(b, ["id", "source"], "left").select("id", "ordinal", F.coalesce("literal", "line").alias("line"))
    return j.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("content"))
