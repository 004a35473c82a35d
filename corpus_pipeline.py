"""A training corpus from documents: five stages, each on all that the one before it kept, written and read again between.

Quality rules drop documents; of each group of near copies one document stays; documents that benchmarks leaked into go;
sources are mixed to their targets, so that a document may be there twice; and what is left becomes shards of token
sequences in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merkleframe.llm import op1_decontamination, op3_quality_rules, op4_training_order, op6_ngram_join, op10_mixing
from merkleframe.session import scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_quality_rules.keep_good(docs)


#: Near copies of the stage: shingles of so many words, and the similarity in hundredths. The op6 query has values of its own.
SHINGLE, PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_ngram_join.one_of_each(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontamination.remove(docs, table(spark, sf_dir, "benchmark"), "documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_mixing.curriculum(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shards = op4_training_order.write_shards(docs, scratch(spark))
    return op4_training_order.read_shards(shards).select("slot", "shard", F.sha2("tokens", 256).alias("tokens_sha256"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", training_order),
]

#: Outlier estimates, components and tokens are beyond SQL; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
