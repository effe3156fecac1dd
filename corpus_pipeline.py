"""Corpus pipeline: language, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontam, langid, mixing, neardup, sharding
from ledgerlake.llm.common import table
from ledgerlake.session import ensure_checkpoint_dir

#: A text is rejected under this score. Two families and languages that the
#: models cannot tell apart still give 0.25, so only texts go whose letters
#: are mostly foreign to all learned languages.
MIN_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: no text, no letter or a foreign
    alphabet is rejected."""
    found = langid.identify(docs, docs)
    return (found.where((F.col("_ll_pred.lang") != langid.UND) & (F.col("_ll_pred.score") >= MIN_LANGUAGE_SCORE))
            .select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles,
    similarity 0.8 or more, the smallest doc_id stays."""
    return neardup.drop_near_duplicates(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs, mixing.mix(docs, mixing.words(F.col("text"))))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return sharding.shard_query(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Classifier, signatures and random rounding have no SQL; the stages are
#: tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the
    shared folder of the session's checkpoints."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{ensure_checkpoint_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
