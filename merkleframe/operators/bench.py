"""Grouped statistics of benchmark observations, and how runs compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(value: str, q: float) -> Column:
    """The value at rank ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def aggregates(obs: DataFrame, identity: list[str], value: str) -> DataFrame:
    """Samples, median and p95 by nearest rank, least and most, of each identity."""
    return obs.groupBy(*identity).agg(F.count("*").alias("samples"), nearest_rank(value, 0.5).alias("median"), nearest_rank(value, 0.95).alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"))


def melt(obs: DataFrame, keep: list[str], metrics: dict[str, Column]) -> DataFrame:
    """A row for each metric of each observation: (keep, metric, value)."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()))
    return obs.select(*keep, F.explode(each).alias("m")).select(*keep, "m.metric", "m.value")


def coalesce_repeats(metrics: DataFrame, identity: list[str]) -> DataFrame:
    """Repeats as one value: nearest-rank p95 for metrics named ``p95_``, interpolated median for others; only metrics that every repeat has."""
    g = metrics.groupBy(*identity, "metric").agg(F.count("*").alias("repeats"), F.count("value").alias("_n"), F.median("value").alias("_median"), nearest_rank("value", 0.95).alias("_p95"))
    value = F.when(F.col("metric").startswith("p95_"), F.col("_p95")).otherwise(F.round("_median", 9))
    return g.where("_n = repeats").select(*identity, "metric", "repeats", value.alias("value"))


def change_percent(base: Column, head: Column) -> Column:
    """Null from a base of zero."""
    return F.when(base != 0, (head - base) / F.abs(base) * 100)


def outcome(base: Column, head: Column, direction: str = "lower") -> Column:
    moved = F.lit("informational") if direction == "neutral" else F.when(head > base, "increased").otherwise("decreased")
    return F.when(head == base, "unchanged").otherwise(moved)


def compare(base: DataFrame, head: DataFrame, identity: list[str], direction: str = "lower") -> DataFrame:
    """(identity, base, head, change, outcome) of runs (identity, value, ok): one-sided identities and failed ones have no change."""
    b = base.select(*identity, F.col("value").alias("base"), F.col("ok").alias("_b"))
    h = head.select(*identity, F.col("value").alias("head"), F.col("ok").alias("_h"))
    j = b.join(h, identity, "full_outer")
    both = F.col("_b") & F.col("_h")
    said = F.when(F.col("_h").isNull(), "base only").when(F.col("_b").isNull(), "head only").when(~both, "skipped").otherwise(outcome(F.col("base"), F.col("head"), direction))
    return j.select(*identity, "base", "head", F.when(both, change_percent(F.col("base"), F.col("head"))).alias("change"), said.alias("outcome"))


def revision_series(runs: DataFrame, identity: list[str]) -> DataFrame:
    """Change of each run (identity, run, value) against the run just before it, null if that one is missing, and against the first."""
    w = W.partitionBy(*identity).orderBy("run")
    x = runs.withColumn("_lag", F.lag("value").over(w)).withColumn("_run", F.lag("run").over(w)).withColumn("_first", F.first("value").over(w))
    x = x.withColumn("previous", F.when(F.col("_run") == F.col("run") - 1, F.col("_lag")))
    r = lambda c: F.round(c, 6)
    return x.select(*identity, "run", r("value").alias("value"), r("previous").alias("previous"), r(change_percent(F.col("previous"), F.col("value"))).alias("change"), r(change_percent(F.col("_first"), F.col("value"))).alias("change_from_baseline"))


def flatten_metrics(df: DataFrame, column: str) -> DataFrame:
    """(name, median, n) of the numbers in a JSON column."""
    m = df.select(F.explode(F.from_json(column, "map<string,double>")).alias("name", "value"))
    return m.groupBy("name").agg(F.median("value").alias("median"), F.count("*").alias("n"))


def fallback_pairs(left: DataFrame, right: DataFrame, name: str, package: str, key: str) -> DataFrame:
    """Left rows paired by name, or else by a package that the right side has once."""
    by_name = right.groupBy(name).agg(F.min(key).alias("_name_key"))
    by_package = right.groupBy(package).agg(F.min(key).alias("_package_key"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    j = left.join(by_name, name, "left").join(by_package, package, "left")
    category = F.when(F.col("_name_key").isNotNull(), "name").when(F.col("_package_key").isNotNull(), "package").otherwise("unpaired")
    return j.select(*left.columns, F.coalesce("_name_key", "_package_key").alias("pair"), category.alias("category"))


def export_json(metrics: DataFrame) -> DataFrame:
    """(name, document): the metrics of each name as one JSON object, keys sorted."""
    entry = F.struct(F.col("metric").alias("key"), F.struct("value").alias("value"))
    return metrics.groupBy("name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))).alias("document"))


def failures(obs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that an observation breaks."""
    broken = F.filter(F.array(*(F.when(rule, name) for name, rule in rules.items())), lambda x: x.isNotNull())
    return obs.withColumn("failure", F.explode(broken))


def balanced_jobs(names: DataFrame, repetitions: int) -> DataFrame:
    """(corpus, repetition, place, name): each repetition begins with the next name."""
    w = W.partitionBy("corpus")
    n = names.withColumn("_i", F.row_number().over(w.orderBy("ord")) - 1).withColumn("_k", F.count("*").over(w))
    n = n.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    return n.select("corpus", "repetition", F.pmod(F.col("_i") - F.col("repetition"), F.col("_k")).cast("int").alias("place"), "name")
