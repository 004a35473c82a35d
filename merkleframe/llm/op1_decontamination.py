"""Benchmark decontamination: find benchmark n-grams in documents; remove the spans or the documents.

Native. Benchmark items become windows of 13 words, whose distinct texts are a broadcast hash set. Each document
is scanned within its row: a fixed bitmap of the windows' four anchor words picks the positions at which a window
may start; only those become rows, and joining on the window's words verifies each. Document text isn't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merkleframe.llm.text import LOWER, UPPER, ascii_lower, fresh, split_words
from merkleframe.session import table, written

WINDOW = 13
#: Words are what lies between these.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmarks of up to so many distinct windows are broadcast and get a bitmap; larger ones are joined by a shuffle.
MAX_BROADCAST = 1_000_000
MAX_BITS = 1 << 24


def _words(c: Column) -> Column:
    return split_words(ascii_lower(c), SEPARATORS)


def _anchors(words: Column, start: Column, length: int) -> Column:
    """A hash of four words, spread over the window of ``length`` words at the 0-based start."""
    at = sorted({0, (length - 1) // 3, 2 * (length - 1) // 3, length - 1})
    return F.xxhash64(F.lit(length), *(F.get(words, start + i) for i in at))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, len, window): the distinct windows of each item; an item of fewer words, but not none, is one window."""
    b = benchmark.select("item_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    b = b.select("item_id", "w", F.least(F.size("w"), F.lit(size)).alias("len"))
    b = b.select("item_id", "w", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    return b.select("item_id", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("window")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, version, copies, n_words, n_hit, items, spans) for every distinct document row.

    ``items``: the sorted item_ids, as strings, that have a window in it. ``spans``: the hit words as disjoint
    array<struct<start, end>> of 0-based word positions. ``copies``: how many rows share this doc_id and text; a
    null doc_id is an id like any other. A null or empty text has no words and no hits; nor does anything if the
    benchmark is empty.
    """
    win = written(windows(benchmark, size))
    grouped = written(win.groupBy("len", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids")))
    n = grouped.count()
    lengths = sorted(r[0] for r in grouped.select("len").distinct().collect())  # at most ``size`` of them
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), _words(F.col("text")).alias("w"))
    small = n <= MAX_BROADCAST
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(12, (128 * n).bit_length()))
    found = []
    for length in lengths:
        test = _bitmap(grouped.where(F.col("len") == length), length, bits) if small else None
        found.append(_starts(length, test))
    base = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len")))
    d = d.select("doc_id", "version", "w", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(base, *found)).alias("c"))
    d = d.select("doc_id", "version", "n_words", "c", F.when(F.col("c.at") >= 0, F.array_join(F.expr("slice(w, c.at + 1, c.len)"), " ")).alias("window"))
    keys = grouped.select("window", "item_ids")
    d = d.join(F.broadcast(keys) if small else keys, "window", "left").where("c.at < 0 OR item_ids IS NOT NULL")
    out = d.groupBy("doc_id", "version", "n_words").agg(
        F.sum(F.when(F.col("c.at") < 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("c.at") >= 0, F.col("c")))).alias("c"),
    )
    return out.select("doc_id", "version", "copies", "n_words", "items", _spans(F.col("c")).alias("spans")).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    )


def _starts(length: int, test) -> Column:
    """The (at, len) of the positions in the words ``w`` at which a window of this length may start."""
    start = F.sequence(F.lit(0), F.size("w") - length)
    if test is not None:
        start = F.filter(start, lambda i: test(_anchors(F.col("w"), i, length)))
    start = F.when(F.size("w") >= length, start).otherwise(F.array().cast("array<int>"))
    return F.transform(start, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len")))


def _bitmap(win: DataFrame, length: int, bits: int):
    """A test of an anchor hash against a bitmap literal, of ``bits`` bits at most, of all windows of a length."""
    w = F.split("window", " ")
    anchors = win.select(F.pmod(_anchors(w, F.lit(0), length), F.lit(bits)).alias("a")).distinct()
    set_bits = [r[0] for r in anchors.collect()]  # at most MAX_BROADCAST, from the benchmark alone
    words = [0] * (bits // 64)
    for b in set_bits:
        words[b >> 6] |= 1 << (b & 63)
    text = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in words)
    literal = F.split(F.lit(text), ",").cast("array<bigint>")  # folded once, when the plan is optimised

    def test(h: Column) -> Column:
        b = F.pmod(h, F.lit(bits))
        word = F.get(literal, F.shiftright(b, 6).cast("int"))
        return F.getbit(word, F.pmod(b, F.lit(64)).cast("int")) == 1

    return test


def _spans(c: Column) -> Column:
    """Sorted (at, len) as disjoint, merged (start, end)."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        end = x["at"] + x["len"]
        new = F.array(F.struct(x["at"].alias("start"), end.alias("end")))
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))
        return F.when((F.size(acc) > 0) & (x["at"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.concat(acc, new)).cast(kind)

    return F.aggregate(c, F.array().cast(kind), add)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW, share: bool = False) -> DataFrame:
    """``docs`` without the documents that have a hit, or ("spans") with the hit words cut out of their texts.

    With ``share`` only those documents go of whose words at least a twentieth is hit; longer ones keep their passages.
    Columns and clean rows stay as they are.
    """
    h = hits(docs, benchmark, size)
    own, gid, gversion, spans = fresh(docs, "own", "hit_id", "hit_version", "spans")
    d = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(gid)) & (F.col(own) == F.col(gversion))
    ids = [F.col("doc_id").alias(gid), F.col("version").alias(gversion)]
    if mode == "documents":
        return d.join(h.where(contaminated() if share else "n_hit > 0").select(*ids), same, "left_anti").select(*docs.columns)
    if mode != "spans":
        raise ValueError(mode)
    out = d.join(h.where("n_hit > 0").select(*ids, F.col("spans").alias(spans)), same, "left")
    word, gap = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    piece = F.transform(
        F.sequence(F.lit(0), F.size(word) - 1),
        lambda i: F.concat(F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), "").otherwise(F.get(word, i)), F.get(gap, i + 1)),
    )
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.get(gap, F.lit(0)), F.array_join(piece, "")))
    return out.withColumn("text", text).select(*docs.columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    h = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    h = h.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return h.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


QUERIES = {"op1_decontamination": op1_decontamination}

_SQL_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE = {
    "op1_decontamination": f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i + 1 : i + l], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS l, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM win)),
cand AS (SELECT doc_id, l, i, array_to_string(w[i + 1 : i + l], ' ') AS win FROM pos),
hit AS (SELECT doc_id, i, c.l, item_id FROM cand c JOIN win USING (l, win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
}
