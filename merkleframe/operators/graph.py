"""Traversal of a link graph: closures, marks, first failures and expansions, as rounds of joins.

A round joins the newest keys with the links and keeps what wasn't seen. Each round is written to the shared folder, so a
plan is one round long and a lost executor costs one round at most; keys never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merkleframe.session import written


class LimitExceeded(Exception):
    """A traversal visited more objects than it may."""


def reach(seeds: DataFrame, links: DataFrame, max_objects: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(key, depth): what the seeds (key) reach over links (src, dst), by least depth, seeds at 0.

    Keys of ``stop`` (key) count, but aren't followed. Keys without a link are leaves; whether they exist is not asked. The
    links are written once, so that no round derives them anew.
    """
    links = written(links.select("src", "dst"))
    new = written(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    seen, total, depth = new, new.count(), 0
    while True:
        if max_objects is not None and total > max_objects:
            raise LimitExceeded(f"more than {max_objects} objects")
        start = new.join(stop.select("key"), "key", "left_anti") if stop is not None else new
        depth += 1
        found = start.join(links, start["key"] == links["src"]).select(F.col("dst").alias("key")).distinct()
        new = written(found.join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)))
        n = new.count()
        if not n:
            return seen
        total += n
        seen = seen.unionByName(new)


def reach_from_each(seeds: DataFrame, links: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(root, key, depth): the closure of each root by itself, roots at 0."""
    links = written(links.select("src", "dst"))
    new = written(seeds.select(F.col("key").alias("root"), "key", F.lit(0).alias("depth")).distinct())
    seen, depth = new, 0
    while True:
        start = new.join(stop.select("key"), "key", "left_anti") if stop is not None else new
        depth += 1
        found = start.join(links, start["key"] == links["src"]).select("root", F.col("dst").alias("key")).distinct()
        new = written(found.join(seen, ["root", "key"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def closure_status(seeds: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """(root, status, objects): Complete with the number of objects, Missing without the root itself, Incomplete with a gap below it."""
    c = reach_from_each(seeds, links)
    known = objects.select("key").withColumn("known", F.lit(True))
    c = c.join(known, "key", "left")
    gap = F.max(F.when(F.col("known").isNull(), 1).otherwise(0))
    root_gap = F.max(F.when(F.col("known").isNull() & (F.col("depth") == 0), 1).otherwise(0))
    out = c.groupBy("root").agg(F.count("*").alias("n"), gap.alias("gap"), root_gap.alias("root_gap"))
    status = F.when(F.col("root_gap") == 1, "Missing").when(F.col("gap") == 1, "Incomplete").otherwise("Complete")
    return out.select("root", status.alias("status"), F.when(F.col("gap") == 0, F.col("n")).alias("objects"))


def first_missing(seeds: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """(root, from_key, missing_key): of each root's closure the gap that a breadth-first walk meets first.

    Links of a node are followed in the order of their target; the walk's order is the path of such ranks to a node, level
    by level, so that the first gap is the one with the least depth, then the least path.
    """
    ranked = written(links.select("src", "dst"))
    new = written(seeds.select(F.col("key").alias("root"), "key", F.array(F.col("key")).alias("path")))
    known = objects.select("key")
    seen = new.select("root", "key")
    while not new.isEmpty():
        step = new.join(known, "key", "left_semi").join(ranked, new["key"] == ranked["src"]).select("root", F.col("key").alias("from_key"), F.col("dst").alias("key"), F.concat("path", F.array("dst")).alias("path"))
        gap = step.join(known, "key", "left_anti")
        found = written(gap.groupBy("root").agg(F.min_by(F.struct("from_key", "key"), "path").alias("m")).select("root", "m.from_key", F.col("m.key").alias("missing_key")))
        done = found if "done" not in locals() else done.unionByName(found)
        rest = step.join(found.select("root"), "root", "left_anti").join(seen, ["root", "key"], "left_anti")
        new = written(rest.groupBy("root", "key").agg(F.min("path").alias("path")))
        seen = seen.unionByName(new.select("root", "key"))
    return done


def expand_paths(roots: DataFrame, entries: DataFrame, max_depth: int = 64) -> DataFrame:
    """(path, key, depth) of each entry below the roots (path, key), over entries (dir, name, child)."""
    new, depth = written(roots.select("path", "key", F.lit(0).alias("depth"))), 0
    out = new
    while depth < max_depth:
        depth += 1
        step = new.join(entries, new["key"] == entries["dir"])
        new = written(step.select(F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "name").alias("path"), F.col("child").alias("key"), F.lit(depth).alias("depth")))
        if new.isEmpty():
            return out
        out = out.unionByName(new)
    raise LimitExceeded(f"deeper than {max_depth}")


def resolve_symbolic(refs: DataFrame, max_hops: int = 32) -> DataFrame:
    """(name, target, hops, error) of refs (name, target, symbolic): targets of symbolic refs are names, followed to a direct one.

    ``error`` is ``missing`` for a name that isn't there, ``cycle`` for one that comes again, and ``too many hops``.
    """
    none = F.lit(None).cast("string")
    names = written(refs.select(F.col("name").alias("_name"), F.col("target").alias("_target"), F.col("symbolic").alias("_symbolic")))
    open_ = written(refs.select("name", "target", "symbolic", F.array("name").alias("path")))
    done = open_.where("NOT symbolic").select("name", "target", F.lit(0).alias("hops"), none.alias("error"))
    open_ = open_.where("symbolic")
    for hop in range(1, max_hops + 1):
        step = written(open_.join(names, F.col("target") == F.col("_name"), "left"))
        if step.isEmpty():
            return done
        again = F.col("_symbolic") & F.array_contains(F.concat("path", F.array("target")), F.col("_target"))
        error = F.when(F.col("_name").isNull(), "missing").when(again, "cycle")
        over = step.where(error.isNotNull() | ~F.col("_symbolic"))
        done = done.unionByName(over.select("name", F.when(error.isNull(), F.col("_target")).alias("target"), F.lit(hop).alias("hops"), error.alias("error")))
        open_ = step.where(error.isNull() & F.col("_symbolic")).select("name", F.col("_target").alias("target"), F.lit(True).alias("symbolic"), F.concat("path", F.array("target")).alias("path"))
    return done.unionByName(open_.select("name", none.alias("target"), F.lit(max_hops).alias("hops"), F.lit("too many hops").alias("error")))
