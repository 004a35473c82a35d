"""Numbers and running totals in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.session import written


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt in ranges of the order, with the number of their range; written, so that it stays what it is."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` of all rows up to and with each one. The order must not tie.

    Ranges are summed each by itself, their sums are added up, a row for each range, and go back to the rows.
    """
    r = _ranged(df, order)
    sums = r.groupBy("_part").agg(F.sum(value).alias("_sum"))
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return r.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + inside).select(*df.columns, name)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds each row's number in the order, from ``start``."""
    out = running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name)
    return out.withColumn(name, (F.col(name) + (start - 1)).cast("long")).drop("_one")
