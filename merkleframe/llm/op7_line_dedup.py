"""Line dedup: lines that several documents hold stay in the first of them only.

Native. Lines become 128-bit hashes. They are range-partitioned by hash, with a secondary sort by document and position; a
window streams over each sorted range and carries a hash's first document to the lines that follow it. Hashes are counted
in a sketch of fixed size before, and those that may be in very many lines are salted by document: their runs are then
parts of a hash, and the heads of the runs, a document's lines each, are compared once more. Nothing else is shuffled
again. Documents get back the kept lines as runs of positions, a compressed bitmap, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.llm.text import BLANK, LOWER, UPPER, ascii_lower, fresh
from merkleframe.session import table, written

MIN_CHARS = 10
#: Counters of the sketch, and how many lines, or four times the average, a hash's counter may have before the hash is salted.
COUNTERS, HOT = 1 << 16, 1_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _version(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _salted(line: DataFrame) -> DataFrame:
    """The lines with a salt: -1, or for hashes whose counter in the sketch is above HOT a part of their documents."""
    counts = line.groupBy(_counter().alias("counter")).agg(F.count("*").alias("in_counter"))
    # COUNTERS rows at most.
    limit = max(HOT, 4 * line.count() // COUNTERS)
    hot = counts.where(f"in_counter > {limit}").select("counter", F.ceil(F.col("in_counter") / limit).cast("int").alias("parts"))
    line = line.withColumn("counter", _counter()).join(F.broadcast(hot), "counter", "left")
    return line.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.lit(11), "doc_id"), "parts").cast("int"), F.lit(-1))).drop("counter", "parts")


def _counter() -> Column:
    return F.pmod("h2", F.lit(COUNTERS)).cast("int")


def _repeats(line: DataFrame) -> DataFrame:
    """Of the stored lines (doc_id, version, pos, h1, h2), those that a smaller doc_id has too."""
    ranged = _salted(line).repartitionByRange("h1", "h2", "salt")
    # The ranges hold whole runs, so that the window needs no other exchange; it streams each range in its sorted order.
    run = W.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = ranged.withColumn("first_doc", F.first("doc_id").over(run))
    # A salted run's own first document may yet come after that of another run.
    later = written(seen.where("doc_id > first_doc OR salt >= 0"))
    heads = later.where("salt >= 0 AND doc_id = first_doc")
    least = F.min("doc_id").over(W.partitionBy("h1", "h2"))
    more = heads.withColumn("least", least).where("doc_id > least")
    names = ["doc_id", "version", "pos"]
    return later.where("doc_id > first_doc").select(*names).union(more.select(*names))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, n_dropped, dropped): for each document that loses lines, these, as runs array<struct<start, len>>.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``min_chars``
    code points that two or more documents hold are dropped everywhere but in the smallest doc_id holding
    them. Rows whose doc_id is null take no part and lose nothing. Rows that repeat a doc_id are one document.
    """
    d = docs.select(F.col("doc_id"), F.col("text")).where("doc_id IS NOT NULL")
    line = d.select("doc_id", _version(F.col("text")).alias("version"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANK)))
    line = line.select("doc_id", "version", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    # A second seed makes the second half independent of the first.
    line = line.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    gone = _repeats(written(line)).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    return gone.select("doc_id", "version", F.size("pos").cast("long").alias("n_dropped"), _runs(F.col("pos")).alias("dropped"))


def _runs(pos: Column) -> Column:
    """Sorted, distinct positions as array<struct<start, len>>."""
    start = F.filter(pos, lambda x, i: (i == 0) | (F.get(pos, i - 1) < x - 1))
    last = F.filter(pos, lambda x, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) > x + 1))
    return F.zip_with(start, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("len")))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The kept positions as array<struct<start, len>>, given the runs of the dropped ones."""
    low = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["start"] + r["len"]))
    high = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(n_lines))
    runs = F.zip_with(low, high, lambda a, b: F.struct(a.alias("start"), (b - a).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus n_lines, n_dropped and keep_runs.

    A null or empty text is one empty line, and stays so. Other columns pass through; ones that are named like
    the added columns are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep_runs")
    own, gone, lines, n = fresh(docs, "own", "dropped", "lines", "n_gone")
    drops = keep_bitmaps(docs, min_chars).select("doc_id", F.col("version").alias(own), F.col("dropped").alias(gone), F.col("n_dropped").alias(n))
    out = docs.withColumn(own, _version(F.col("text"))).join(drops, ["doc_id", own], "left")
    out = out.withColumn(gone, F.coalesce(gone, F.array().cast("array<struct<start:int,len:int>>"))).withColumn(lines, _lines(F.col("text"))).withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(n, F.lit(0).cast("long"))).withColumn("keep_runs", keep_runs(F.col(gone), F.size(lines)))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["len"])))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", text).select(*docs.columns, "n_lines", "n_dropped", "keep_runs")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}

ORACLE = {
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT k.*, coalesce(k.doc_id > f.first_doc, false) AS dropped FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
