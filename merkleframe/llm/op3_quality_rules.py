"""Quality rules: base rules, then robust multivariate outliers by language and source.

Each document gets a vector of transformed statistics. For each group of a language and a source, the minimum covariance
determinant is estimated over all its rows: from medians and median deviations, concentration steps keep the rows nearest
to the estimate, a share CORE of the group, and estimate anew. Rows whose squared Mahalanobis distance is beyond CUT go.
No step gathers a group: medians and the share come from histograms on a fixed grid, the estimates from sums. What
returns to a row is its group's mean and inverse covariance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from merkleframe.llm import arrays as A
from merkleframe.llm.text import fresh
from merkleframe.session import table, written

MIN_WORDS = 50
#: Share of a group's rows that its estimate rests on, and the steps towards it.
CORE, STEPS = 0.75, 5
#: Rows of smaller groups are judged by the estimate of their whole language, and those of smaller languages by that of all rows.
MIN_GROUP = 200
#: Median of chi-square of DIMS degrees, to which distances are scaled, and the squared distance beyond which a row goes.
DIMS, CHI_MEDIAN, CUT = 4, 3.3567, 100.0
#: Rows that the estimate of all rows needs: as many as put DIMS + 1 into the core, fewer of which span no covariance.
LEAST = int(DIMS / CORE) + 1
#: Least standard deviation of each statistic, so that one that most rows share isn't infinitely strict.
FLOOR = (0.05, 0.5, 0.5, 0.5)
#: Groups whose estimates are broadcast at most, of some 200 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Bins to a unit of a statistic, and of the logarithm of a squared distance.
GRID, GRID_D = 256, 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which items occur twice or more in their row, and at [1] which have an equal one before."""
    key = A.mix(h + A.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros((2, len(h)), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return np.stack([twice, later])


def _count(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of each row."""
    n = len(offsets) - 1
    starts, ends, rows = A.words(buf, offsets)
    bounds = A.per_row(rows, n)

    def by_row(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    # Code points of words: bytes that don't go on with one, and aren't blank.
    chars = by_row(((buf & 0xC0) != 0x80) & ~A.BLANK[buf])
    symbols = by_row(_SYMBOL[buf])
    edges = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(buf == 10) + 1]))
    edges = edges[edges < len(buf)]
    stops = np.concatenate([edges[1:], [len(buf)]]) if len(edges) else edges
    stops = np.where(buf[stops - 1] == 10, stops - 1, stops) if len(edges) else stops
    solid = np.searchsorted(starts, stops) > np.searchsorted(starts, edges)
    edges, stops = edges[solid], stops[solid]
    line_rows = np.searchsorted(offsets, edges, side="right") - 1
    dup_lines = np.bincount(line_rows[_repeats(line_rows, A.segment_hashes(buf, edges, stops))[1]], minlength=n) if len(edges) else np.zeros(n, np.int64)
    h, at = A.shingles(A.segment_hashes(buf, starts, ends), bounds, 3)
    hit = np.zeros(len(starts) + 3, bool)
    hit[at[_repeats(rows[at], h)[0]]] = True
    covered = hit[:-2] | np.concatenate([[False], hit[:-3]]) | np.concatenate([[False, False], hit[:-4]])
    repeat = np.bincount(rows[covered[: len(starts)]], minlength=n)
    return [np.diff(bounds), chars, symbols, dup_lines, repeat]


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lang, source, and the five counts as long) of each row; a null text has no words."""

    def count(batches):
        for batch in batches:
            text = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            parts = [_count(*A.text_bytes(text.slice(a, b - a))) for a, b in A.slices(text)]
            cols = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "version", "lang", "source")), *map(pa.array, cols)], ["doc_id", "version", "lang", "source", *_COUNTS])

    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    return d.mapInArrow(count, f"doc_id {dict(d.dtypes)['doc_id']}, version long, lang string, source string, {kinds}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.col("n_words").cast("double")
    rate = lambda c: F.log1p(1000 * F.col(c) / n)
    return [F.log(F.col("word_chars") / n), rate("n_symbols"), rate("n_dup_lines"), F.log1p(100 * F.col("n_repeat_words") / n)]


def _rank_bin(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, at): the bin in which ``share`` of each key's rows is reached, given (keys, bin, k)."""
    w = W.partitionBy(*keys)
    df = df.withColumn("upto", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w))
    return df.where(F.col("upto") >= F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.min("bin").alias("at"))


def _few(df: DataFrame) -> DataFrame:
    """A written table of a row for each group, to be broadcast if it is small: rows of a hot group then stay where they are."""
    df = written(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _inverse(df: DataFrame) -> DataFrame:
    """(grp, mean, inv) from (grp, k, sums, products)."""

    def invert(batches):
        for batch in batches:
            means, inverses = [], []
            for k, s, p in zip(batch["k"].to_pylist(), batch["sums"].to_pylist(), batch["products"].to_pylist(), strict=True):
                mean = np.array(s) / k
                cov = np.array(p).reshape(DIMS, DIMS) / k - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                scale = np.maximum(sd, FLOOR)
                # Correlations stay, a little shrunk so that the inverse exists; too small deviations are lifted.
                corr = 0.95 * cov / np.outer(sd, sd) + 0.05 * np.diag(np.diag(cov) / sd**2)
                np.fill_diagonal(corr, 1)
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(corr * np.outer(scale, scale)).ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch["grp"], pa.array(means, kind), pa.array(inverses, kind)], ["grp", "mean", "inv"])

    return df.mapInArrow(invert, "grp string, mean array<double>, inv array<double>")


def _distance() -> Column:
    dev = [F.col(f"x{i}") - F.col("mean")[i] for i in range(DIMS)]
    return sum(F.col("inv")[i * DIMS + j] * dev[i] * dev[j] for i in range(DIMS) for j in range(DIMS))


def _bin_d(d: Column) -> Column:
    return F.floor(F.log1p(F.greatest(d, F.lit(0.0))) * GRID_D).cast("int")


def estimates(stats: DataFrame) -> DataFrame:
    """(grp, mean, inv) of each group, distances scaled to chi-square, from (grp, x0, x1, ...)."""
    xs = [f"x{i}" for i in range(DIMS)]
    long = stats.select("grp", F.posexplode(F.array(*xs)).alias("dim", "x"))
    binned = lambda df, x: df.groupBy("grp", "dim", F.floor(x * GRID).cast("long").alias("bin")).agg(F.count("*").alias("k"))
    med = written(_rank_bin(binned(long, F.col("x")), ["grp", "dim"], 0.5).select("grp", "dim", (F.col("at") / GRID).alias("med")))
    dev = _rank_bin(binned(long.join(F.broadcast(med) if med.count() <= DIMS * MAX_BROADCAST else med, ["grp", "dim"]), F.abs(F.col("x") - F.col("med"))), ["grp", "dim"], 0.5)
    start = med.join(dev, ["grp", "dim"]).withColumn("var", F.pow(F.greatest(1.4826 * F.col("at") / GRID, F.get(F.array(*map(F.lit, FLOOR)), F.col("dim"))), F.lit(2.0)))
    by_dim = F.transform(F.array_sort(F.collect_list(F.struct("dim", "med", "var"))), lambda s: F.struct(s["med"].alias("m"), s["var"].alias("v")))
    cell = [(F.lit(1.0) / F.col("s")[i]["v"]) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]
    now = start.groupBy("grp").agg(by_dim.alias("s")).select("grp", F.col("s.m").alias("mean"), F.array(*cell).alias("inv"))
    for _ in range(STEPS):
        now = _few(now)
        far = written(stats.join(now, "grp").select("grp", *xs, _bin_d(_distance()).alias("bin")))
        core = _rank_bin(far.groupBy("grp", "bin").agg(F.count("*").alias("k")), ["grp"], CORE)
        sums = F.array(*(F.sum(x) for x in xs))
        products = F.array(*(F.sum(F.col(x) * F.col(y)) for x in xs for y in xs))
        near = far.join(_few(core), "grp").where("bin <= at").groupBy("grp").agg(F.count("*").cast("double").alias("k"), sums.alias("sums"), products.alias("products"))
        now = _inverse(near)
    now = _few(now)
    far = stats.join(now, "grp").groupBy("grp", _bin_d(_distance()).alias("bin")).agg(F.count("*").alias("k"))
    half = _rank_bin(far, ["grp"], 0.5)
    # A group whose rows are mostly alike has a tiny median; distances are then left as the least deviations give them.
    scale = F.greatest(F.expm1((F.col("at") + 0.5) / GRID_D) / CHI_MEDIAN, F.lit(1.0))
    return _few(now.join(half, "grp").select("grp", "mean", F.transform("inv", lambda v: v / scale).alias("inv")))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, version, counts, base_failed, distance, kept) of every row of ``docs``.

    A text of under MIN_WORDS words, or of which over half the words stand in repeated 3-word windows, fails the base
    rules. Of the others, those with a squared distance of over CUT to their group's estimate are not kept. A null
    language or source is a value like any other. Rows of a group of under MIN_GROUP are judged by the estimate of all rows
    of their language, and where these are fewer too, of all rows that pass the base rules. Only if those are under LEAST in
    all, they are kept, and distance is null. An empty table gives an empty one.
    """
    s = base_statistics(docs).withColumn("base_failed", base_failed())
    ok = ~F.col("base_failed")
    s = written(s.select("*", *(F.when(ok, v).alias(f"x{i}") for i, v in enumerate(_vector()))))
    # With the nulls, so that a group without a source isn't its language, nor one without either all rows.
    pair, lang = (F.to_json(F.struct(*c), {"ignoreNullFields": "false"}) for c in (("lang", "source"), ("lang",)))
    counts = written(s.where(ok).groupBy(pair.alias("pair"), lang.alias("whole")).agg(F.count("*").alias("k")))
    langs = _few(counts.groupBy("whole").agg(F.sum("k").alias("in_lang"), F.min("k").alias("least")))
    every = langs.agg(F.sum("in_lang").alias("in_all"), F.min("in_lang").alias("least_lang"))
    own, by_lang, by_all = F.col("k") >= MIN_GROUP, F.col("in_lang") >= MIN_GROUP, F.col("in_all") >= LEAST
    # The group a row is judged by, and those whose estimates it is a part of: only such as judge some row.
    parts = F.array(F.when(own, F.col("pair")), F.when(by_lang & (F.col("least") < MIN_GROUP), F.col("whole")), F.when(by_all & (F.col("least_lang") < MIN_GROUP), F.lit("{}")))
    grp = F.when(own, F.col("pair")).when(by_lang, F.col("whole")).when(by_all, F.lit("{}"))
    groups = _few(counts.join(langs, "whole").crossJoin(F.broadcast(every)).select("pair", grp.alias("grp"), F.array_compact(parts).alias("parts")))
    s = written(s.withColumn("pair", pair).join(groups, "pair", "left").drop("pair"))
    now = estimates(s.where(ok).select(F.explode("parts").alias("grp"), *(f"x{i}" for i in range(DIMS))))
    out = s.join(now, "grp", "left").withColumn("distance", F.when(ok, _distance()))
    kept = ok & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return out.select("doc_id", "version", *_COUNTS, "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    gone_id, gone_version, own = fresh(docs, "gone_id", "gone_version", "own")
    gone = judged(docs).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("version").alias(gone_version)).distinct()
    d = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    return d.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_version)), "left_anti").select(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", "distance")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
