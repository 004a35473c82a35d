"""Connected components of a link table, by alternating stars; no node gathers its neighbours in a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merkleframe.session import written


#: Links of a node beyond which it is heavy, or a 50,000th of all links if that is more: so there are 100,000 heavy nodes at most.
HEAVY = 128


def _joined(rows: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """Rows (u, v) with the m of their u in low (u, m, k), a row for each u that has k rows. Those of heavy nodes stay where they are."""
    low, limit = written(low), max(HEAVY, links // 50_000)
    heavy = low.where(F.col("k") > limit).select("u", "m")
    light = rows.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(low.where(F.col("k") <= limit).select("u", "m"), "u")
    return rows.join(F.broadcast(heavy), "u").select("u", "v", "m").union(light.select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (u, v): component is the smallest node that it reaches.

    Each round joins every link to the smallest neighbour of its ends; rounds grow with the logarithm of the longest path.
    Every round is written to the shared folder. Null ends and loops are left out; no links give no rows.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    e = written(e)
    seen = None
    while True:
        size = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not size[0] or tuple(size) == seen:
            break
        seen = tuple(size)
        # Larger neighbours go to the smallest one.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = [F.min("v").alias("m"), F.count("*").alias("k")]
        large = _joined(both.where("v > u"), both.groupBy("u").agg(*least), size[0])
        large = written(large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        # Then smaller neighbours, and the node, do.
        x = _joined(large, large.groupBy("u").agg(*least), size[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = written(x.select("x.u", "x.v").where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
