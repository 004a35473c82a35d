"""Mixing sources to target weights: a time-varying curriculum.

Each source has a share of the mix and a rate of use that changes over training time. The integral of its rate is
its cumulative token demand; a document that lies behind ``c`` tokens of its source, in a keyed order, is due when
that demand reaches ``c``. Inverting it gives the document's training position, and documents are range-sorted by it.
Running totals come in two levels, of hash ranges within a source and of documents within a range, so that a source
of a third of all rows isn't one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.llm.text import BLANKS, fresh
from merkleframe.session import table, written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix, against all sizes.
SHARE = 1.5
#: Passes over a source at most.
MAX_PASSES = 2
#: Change of a source's rate from start to end of training, by its place in the order, repeating: +0.5 goes from 0.75 to 1.25 of its mean.
TILTS = (-0.5, 0.0, 0.5)
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of the text; a null one has none."""
    blanks = F.split(F.coalesce("text", F.lit("")), BLANKS)
    return docs.select("doc_id", "source", F.size(F.array_remove(blanks, "")).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, place, source_size, target) of each source.

    Sources share SHARE of all sizes by weight; a target stops at MAX_PASSES times its source's size, and the excess is
    shared among the others by weight until none is above: sources are filled in the order of their limit by weight.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)  # a row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("limit", MAX_PASSES * F.col("source_size"))
    order = W.orderBy(F.col("limit") / F.col("weight"), "place")
    s = s.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (SHARE * F.sum("source_size").over(W.partitionBy()) - F.col("before")) / F.col("left"))
    full = F.col("limit") <= F.col("weight") * F.col("level")
    # The level at which the last sources are, those that aren't full.
    level = F.min(F.when(~full, F.struct("before", "level"))).over(W.partitionBy())["level"]
    target = F.when(full | level.isNull(), F.col("limit").cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "place", "source_size", target.alias("target"))


def _order_key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + SEED)))


def assign(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, before, copies, positions) of every row of ``docs``.

    ``copies`` is 0, 1 or 2; copy j of a document with ``before`` tokens of its source ahead of it is taken if its middle,
    j * source_size + before + size / 2, is within the target, so that a source's taken words miss its target by half a
    document at most. ``positions``: for each copy, when in [0, 1] its source's demand reaches it. Documents without words
    are taken with no weight. Order and copies depend on doc_id and size alone; rows that repeat a doc_id are in the order
    of their sizes. A null source is a source, a null doc_id an id. An empty table gives an empty one.
    """
    sized = written(sizes(docs))
    t = written(targets(sized))
    # Sources are few; past Spark's own limit for a broadcast, this is a shuffled join.
    s = sized.join(t.withColumnRenamed("source", "_source"), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    # As many ranges as a source has documents in each, about, so that both levels grow with the root.
    ranges = 1 << max(4, math.isqrt(sized.count()).bit_length())
    s = s.withColumn("key", _order_key())
    s = written(s.withColumn("range", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % ranges))
    in_range = s.groupBy("place", "range").agg(F.sum("size").alias("range_size"))
    ahead = W.partitionBy("place").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    in_range = in_range.select("place", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("place", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(in_range, ["place", "range"])
    s = s.withColumn("before", F.col("ahead") + F.col("inside"))
    taken = lambda j: j * F.col("source_size") + F.col("before") + F.col("size") / 2 <= F.col("target")
    s = s.withColumn("copies", sum(taken(j).cast("int") for j in range(MAX_PASSES)))
    tilt = F.element_at(F.array(*map(F.lit, TILTS)), (F.col("place") % len(TILTS) + 1).cast("int"))
    at = lambda j: due((j * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0)), tilt)
    positions = F.slice(F.array(*(at(j) for j in range(MAX_PASSES))), 1, F.col("copies"))
    return s.select("doc_id", "source", "size", "source_size", "target", "before", "copies", positions.alias("positions"))


def due(demand: Column, tilt: Column) -> Column:
    """The time in [0, 1] at which a rate that runs from 1 - tilt / 2 to 1 + tilt / 2 has come to ``demand``, a part of 1.

    Its integral is (1 - tilt / 2) t + tilt / 2 t^2.
    """
    a, d = 1 - tilt / 2, F.least(F.greatest(demand, F.lit(0.0)), F.lit(1.0))
    return F.when(tilt == 0, d).otherwise((F.sqrt(a * a + 2 * tilt * d) - a) / F.when(tilt == 0, F.lit(1.0)).otherwise(tilt))


def curriculum(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, range-sorted by training position.

    Rows of no copy go. Columns stay those of ``docs``.
    """
    # Rows alike in id, source and size are told apart by their place. Texts and positions are dealt by key together, and
    # both windows take that, so that the texts are shuffled once here; a join by key and place would deal them anew.
    key, row, positions, before, at = fresh(docs, "key", "row", "positions", "before", "at")
    name = lambda size: F.to_json(F.struct("doc_id", "source", size.alias("size")))
    a = assign(docs).select(name(F.col("size")).alias(key), F.col("before").alias(before), F.col("positions").alias(positions))
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANKS), "")).cast("long")
    d = docs.withColumn(key, name(size)).unionByName(a, allowMissingColumns=True).repartition(key)
    d = d.withColumn(row, F.row_number().over(W.partitionBy(key, F.col(before).isNull()).orderBy(before, "text")))
    d = d.withColumn(positions, F.max(positions).over(W.partitionBy(key, row))).where(F.col(before).isNull())
    d = d.withColumn(at, F.explode(positions))
    return d.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    a = assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    at = [F.get("positions", F.lit(j)).alias(f"position_{j + 1}") for j in range(MAX_PASSES)]
    out = a.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *at)
    return out.repartitionByRange("position_1", "doc_id").sortWithinPartitions("position_1", "doc_id")


QUERIES = {"op10_mixing": op10_mixing}



def _sql_due(j: int) -> str:
    """The position of copy j: the demand of its source, inverted."""
    demand = f"least(({j} * source_size + before)::DOUBLE / greatest(target, 1.0), 1.0)"
    return f"CASE WHEN copies <= {j} THEN NULL WHEN tilt = 0 THEN {demand} ELSE (sqrt((1 - tilt / 2) * (1 - tilt / 2) + 2 * tilt * {demand}) - (1 - tilt / 2)) / tilt END"


ORACLE = {
    "op10_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(place % {len(WEIGHTS)} + 1)::INT] AS weight, {MAX_PASSES} * source_size AS lim FROM s),
v AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         {SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM w
), l AS (SELECT *, (total - before::DOUBLE) / rest::DOUBLE AS level FROM v),
m AS (SELECT arg_min(level, before) AS level FROM l WHERE lim > weight * level),
t AS (
  SELECT l.source, l.place, l.source_size, CASE WHEN l.lim <= l.weight * l.level OR m.level IS NULL THEN l.lim::DOUBLE ELSE l.weight * m.level END AS target
  FROM l LEFT JOIN m ON true
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, [{", ".join(map(str, TILTS))}][(t.place % {len(TILTS)} + 1)::INT]::DOUBLE AS tilt,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(h, 1, 8))::BIGINT % r.n, h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}') AS h FROM d) d
  JOIN t ON d.source IS NOT DISTINCT FROM t.source,
  (SELECT pow(2, greatest(4, length(bin(floor(sqrt(count(*)))::BIGINT))))::BIGINT AS n FROM d) r
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, {_sql_due(0)} AS position_1, {_sql_due(1)} AS position_2
FROM (SELECT *, (before + size / 2.0 <= target)::INT + (source_size + before + size / 2.0 <= target)::INT AS copies FROM k)
"""
}
