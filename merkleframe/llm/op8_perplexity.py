"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the bytes of the text in UTF-8, as they are, and n-grams are ORDER of them, so that letters of any script are
told apart. Counts of all trusted text, continuation counts, discounts, back-off weights and probabilities are tables
sharded by n-gram and joined by n-gram, context and suffix; none of them is gathered, and they grow with the corpus. To
score, each input partition gives its distinct n-grams, once; these are joined with the probabilities, and come back as a
table for each partition, sorted, in the shared folder. A second pass over the documents reads its partition's table and
sums. A document is kept if its perplexity is between quantiles of the trusted documents of its language: text that is too
likely, as the same words over and over may be, goes as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.llm import arrays as A
from merkleframe.llm.op5_zip_archives import _store
from merkleframe.session import scratch, table, written

ORDER, BITS = 5, 8
#: Quantile of the trusted documents' mean negative log likelihood by language, and its counterpart at the low end; and what is
#: granted beyond them, in nats a byte.
QUANTILE, MARGIN = 0.999, 0.05
#: The mean of n bytes is uncertain by this, in nats, over the root of n; so much is granted to each document. At the low end it
#: is twice that, as a passage that many documents share is likely text, and a good short document may be little else.
EVIDENCE = {"high": 4.0, "low": 8.0}
#: Languages of fewer trusted documents take the quantiles of all.
MIN_TRUSTED = 100
#: Bins to a nat.
GRID = 1000
#: Trusted doc_ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def _codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ORDER that ends at each byte, and the row of each; before a text there are zeros."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.arange(len(buf)) - offsets[rows]  # bytes before it in its row
    symbol = buf.astype(np.int64)
    code = symbol.copy()
    for k in range(1, min(ORDER, len(buf))):
        code[k:] |= np.where(inside[k:] >= k, symbol[:-k] << (BITS * k), 0)
    return code, rows


def _batches(batch):
    text = pc.fill_null(batch["text"].cast(pa.large_string()), "")
    for a, b in A.slices(text):
        yield (a, b, *_codes(*A.text_bytes(text.slice(a, b - a))))


def _counted(docs: DataFrame) -> DataFrame:
    """(part, gram, n): how often each n-gram occurs in the texts of each partition."""

    def count(batches):
        part = TaskContext.get().partitionId()
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = []
        for batch in batches:
            for _, _, code, _ in _batches(batch):
                held.append(np.unique(code, return_counts=True))
                if sum(len(u) for u, _ in held) > max(1 << 19, 2 * len(total[0])):
                    total, held = _added([total, *held]), []
        u, n = _added([total, *held])
        for a in range(0, len(u), 1 << 16):
            k = len(u[a : a + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(u[a : a + k]), pa.array(n[a : a + k])], ["part", "gram", "n"])

    return docs.select("text").mapInArrow(count, "part int, gram long, n long")


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(u)).astype(np.int64)


def ngrams(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram occurs in the texts."""
    return _counted(docs).groupBy("gram").agg(F.sum("n").alias("n"))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND((1 << (BITS * (order - 1))) - 1)


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of a table of counts, from how many n-grams have counts of 1 to 4."""
    r = counts.agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5))).first()
    n = [max(x, 1) for x in r]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), float(i)) for i in (1, 2, 3)]


def model(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of its n-grams, and (ctx, back) of its contexts, from texts."""
    top = written(ngrams(trusted))
    counts = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        # Continuations: how many symbols an n-gram is seen after.
        counts[k] = written(counts[k + 1].groupBy(_suffix(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n")))
    out = []
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = counts[k].withColumn("ctx", _context(F.col("gram"))).withColumn("cut", cut)
        ctx = written(c.groupBy("ctx").agg(F.sum("n").alias("all"), (F.sum("cut") / F.sum("n")).alias("back")))
        c = c.join(ctx, "ctx").withColumn("own", (F.col("n") - F.col("cut")) / F.col("all"))
        if k == 1:
            p = c.select("gram", (F.col("own") + F.col("back") / (1 << BITS)).alias("p"))
        else:
            low = out[-1][0].select(F.col("gram").alias("low"), F.col("p").alias("p_low"))
            p = c.withColumn("low", _suffix(F.col("gram"), k)).join(low, "low").select("gram", (F.col("own") + F.col("back") * F.col("p_low")).alias("p"))
        out.append((written(p), ctx.select("ctx", "back")))
    return out


def probabilities(grams: DataFrame, orders: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, p) of n-grams, seen in training or not: the longest suffix seen, times the weight of each context backed off from."""
    g = grams.select("gram").withColumn("weight", F.lit(1.0)).withColumn("p", F.lit(None).cast("double"))
    for k in range(ORDER, 0, -1):
        p, ctx = orders[k - 1]
        tail = F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)
        g = g.withColumn("tail", tail).withColumn("ctx", _context(F.col("tail")))
        g = g.join(p.select(F.col("gram").alias("tail"), F.col("p").alias("seen")), "tail", "left").join(ctx, "ctx", "left")
        seen = F.coalesce("p", F.col("weight") * F.col("seen"))
        g = g.select("gram", seen.alias("p"), (F.col("weight") * F.coalesce("back", F.lit(1.0))).alias("weight"))
    return g.select("gram", F.coalesce("p", F.col("weight") / (1 << BITS)).alias("p"))


def scored(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, n_symbols, nll) of every row of ``docs``; nll is null without a byte.

    ``docs`` is read twice and must be split alike both times, as a stored table is; if it isn't, that is an error.
    """
    ids = written(trusted_ids.select(F.col("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True)))
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    orders = model(docs.join(ids, "doc_id", "left_semi"))
    d = docs.select("doc_id", F.col("lang").cast("string"), "text")
    seen = written(_counted(d).select("part", "gram"))
    found = written(probabilities(seen.select("gram").distinct(), orders).select("gram", (-F.log("p")).cast("float").alias("nll")))
    tables = scratch(docs.sparkSession)
    parts = (seen.agg(F.max("part")).first()[0] or 0) + 1
    by_part = seen.join(found, "gram").repartitionById(parts, "part").sortWithinPartitions("part", "gram")
    by_part.write.partitionBy("part").parquet(tables)

    def score(batches):
        keys = values = None
        for batch in batches:
            sums, sizes = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for a, b, code, rows in _batches(batch):
                if not len(code):
                    continue
                if keys is None:
                    keys, values = _table(f"{tables}/part={TaskContext.get().partitionId()}")
                u, at = np.unique(code, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                if not len(keys) or (keys[place] != u).any():
                    raise ValueError("the documents are split otherwise than before; write them first")
                sums[a:b] = np.bincount(rows, weights=values[place][at], minlength=b - a)
                sizes[a:b] = np.bincount(rows, minlength=b - a)
            mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], pa.array(sizes), mean], ["doc_id", "lang", "n_symbols", "nll"])

    s = written(d.mapInArrow(score, f"doc_id {dict(d.dtypes)['doc_id']}, lang string, n_symbols long, nll double"))
    return s.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def _table(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a partition, sorted, and their values."""
    with _store(uri) as (fs, path):
        if fs.get_file_info(path).type == FileType.NotFound:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        names = sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.base_name.endswith(".parquet"))
        t = pa.concat_tables([pq.read_table(name, filesystem=fs, columns=["gram", "nll"]) for name in names])
    keys, values = t["gram"].to_numpy(), t["nll"].to_numpy()
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def judged(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, n_symbols, perplexity, least, limit, kept) of every row of ``docs`` (doc_id, text, lang).

    Trained on the whole texts of ``trusted_ids``. A document is kept if its perplexity is from ``least`` to ``limit``: the
    quantiles of the trusted documents of its language, with MARGIN and what its length leaves uncertain. Languages of few trusted
    documents, and a null one, have the limits of all. A null or empty text has no perplexity, and is kept; so is everything
    if nothing is trusted. Rows that repeat a doc_id are judged each by its text.
    """
    s = written(scored(docs, trusted_ids))
    limit = written(_limits(s.where("trusted AND nll IS NOT NULL")))
    first = limit.where("lang IS NULL").select("low", "high").first() or (None, None)  # two numbers
    own = limit.where((F.col("all") >= MIN_TRUSTED) & F.col("lang").isNotNull()).select("lang", "low", "high")
    out = s.join(own, "lang", "left")
    for name, number, sign in (("low", first[0], -1), ("high", first[1], 1)):
        out = out.withColumn(name, F.coalesce(name, F.lit(number).cast("double")) + sign * _grant(name))
    kept = F.coalesce(F.col("nll").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "lang", "trusted", "n_symbols", F.exp("nll").alias("perplexity"), F.exp("low").alias("least"), F.exp("high").alias("limit"), kept.alias("kept"))


def _grant(end: str) -> Column:
    return EVIDENCE[end] / F.sqrt(F.greatest("n_symbols", F.lit(1)))


def _limits(trusted: DataFrame) -> DataFrame:
    """(lang, all, low, high): of each language, and of all as null, how many are trusted and the quantiles, on a grid, with MARGIN."""
    ends = (F.struct(F.lit(e).alias("end"), F.floor((F.col("nll") + sign * _grant(e)) * GRID).cast("long").alias("bin")) for e, sign in (("high", -1), ("low", 1)))
    t = trusted.select("lang", F.explode(F.array(*ends)).alias("x")).select("lang", "x.end", "x.bin")
    both = t.where("lang IS NOT NULL").union(t.select(F.lit(None).cast("string"), "end", "bin")).groupBy("lang", "end", "bin").agg(F.count("*").alias("k"))
    w = W.partitionBy("lang", "end")
    both = both.withColumn("upto", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w))
    high = F.min(F.when((F.col("end") == "high") & (F.col("upto") >= F.ceil(QUANTILE * F.col("all"))), F.col("bin")))
    low = F.min(F.when((F.col("end") == "low") & (F.col("upto") > F.floor((1 - QUANTILE) * F.col("all"))), F.col("bin")))
    return both.groupBy("lang").agg(F.max("all").alias("all"), (low / GRID - MARGIN).alias("low"), ((high + 1) / GRID + MARGIN).alias("high"))


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)


QUERIES = {"op8_perplexity": op8_perplexity}
ORACLE: dict[str, str] = {}
