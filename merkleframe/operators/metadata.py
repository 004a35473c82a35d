"""Lookups, pages, snapshots, commits and ledgers over mutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.operators.order import running_total


def batch_lookup(keys: DataFrame, objects: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """One answer for each requested key (ordinal, key), duplicates too; null columns for a miss. Only the columns wanted are read."""
    return keys.join(objects.select(on, *columns), on, "left").select("ordinal", on, *columns)


def prefix_page(rows: DataFrame, key: str, prefix: str, after: str | None, limit: int) -> DataFrame:
    """A page of rows whose key begins with ``prefix``, past the cursor ``after``, and has_more: one more row than asked for tells.

    The range reaches the scan as a minimum, and a maximum that is the next prefix.
    """
    if not 1 <= limit <= 1024:
        raise ValueError("a page has 1 to 1,024 rows")
    if after is not None and not after.startswith(prefix):
        raise ValueError("the cursor is of another prefix")
    hit = rows.where((F.col(key) >= prefix) & F.col(key).startswith(prefix))
    if (end := prefix_end(prefix)) is not None:
        hit = hit.where(F.col(key) < end)
    if after is not None:
        hit = hit.where(F.col(key) > after)
    page = hit.orderBy(key).limit(limit + 1)
    r = F.row_number().over(W.orderBy(key))  # over one page
    page = page.withColumn("_r", r).withColumn("has_more", F.max(r).over(W.partitionBy()) > limit)
    return page.where(F.col("_r") <= limit).drop("_r")


def prefix_end(prefix: str) -> str | None:
    """The least text beyond all that begin with ``prefix``, or null if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i])
        if code < 0x10FFFF:
            return prefix[:i] + chr(0xE000 if code == 0xD7FF else code + 1)
    return None


def latest(log: DataFrame, keys: list[str], order: list[str], as_of: Column | None = None) -> DataFrame:
    """The newest row of each key, at or before a cut. The order must not tie. One aggregation; no key's rows are gathered."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    rows = log if as_of is None else log.where(as_of)
    top = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in [*order, *rest]))


def first_conflict(checks: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """(batch, first_conflict): of each batch's checks (batch, index, key, expected) the first that doesn't hold, null if all do. Expecting null is expecting no row."""
    s = state.select(key, F.col("value").alias("_actual"))
    bad = ~F.col("expected").eqNullSafe(F.col("_actual"))
    return checks.join(s, key, "left").groupBy("batch").agg(F.min(F.when(bad, F.col("index"))).alias("first_conflict"))


def classify_inserts(staged: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each staged row's outcome: insert, noop if the very record is there, conflict if another is."""
    c = current.select(key, F.lit(True).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields))
    same = None
    for f in fields:
        eq = F.col(f).eqNullSafe(F.col(f"_{f}"))
        same = eq if same is None else same & eq
    outcome = F.when(F.col("_there").isNull(), "insert").when(same, "noop").otherwise("conflict")
    return staged.join(c, key, "left").select(*staged.columns, outcome.alias("outcome"))


def replay(log: DataFrame, key: str, order: str, kind: str, ends: list[str]) -> DataFrame:
    """(key, state): the ledger's last word on each key, open or closed."""
    last = latest(log.select(key, order, kind), [key], [order])
    return last.select(key, F.when(F.col(kind).isin(*ends), "closed").otherwise("open").alias("state"))


def eviction_order(roots: DataFrame, size: str, last_use: str, name: str, total: int, target_percent: int) -> DataFrame:
    """Evictable roots from the least recently used, and which go so that usage falls below a percentage.

    A prefix sum: bytes count as each root's own.
    """
    out = running_total(roots, [last_use, name], size, "cum_bytes")
    used = roots.agg(F.sum(size)).scalar()
    return out.withColumn("evict", (used - F.col("cum_bytes") + F.col(size)) * 100 >= F.lit(total) * target_percent)


def delta(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """(op, key) that turn base into head: ``+`` for new or changed keys, ``-`` for gone ones."""
    b, h = base.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), head.select(key, F.col(value).alias("_h"), F.lit(1).alias("_in_h"))
    j = b.join(h, key, "full_outer")
    op = F.when(F.col("_in_h").isNull(), "-").when(F.col("_in_b").isNull() | ~F.col("_b").eqNullSafe(F.col("_h")), "+")
    return j.select(op.alias("op"), key).where("op IS NOT NULL")
