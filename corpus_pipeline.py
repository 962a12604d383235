"""A corpus pipeline: language, exact copies, near copies, source weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.llm import bpe, langid, mixing, storage
from strataform.llm.exact_dedup import distinct_texts
from strataform.llm.queries import WORD_BPE
from strataform.llm.simhash import one_of_each

#: Texts whose best language has less than this share of the evidence are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that no language explains better than the others together.

    Null and empty texts go. Rows are judged one by one, whatever ids they repeat or lack.
    """
    return langid.accepted(docs, MIN_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), keep one row: the largest id, any id before none; of rows alike in both, one."""
    return distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, keep one row: the smallest id, any id before none; texts without a word are alike."""
    return one_of_each(docs)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each row as often as its source's target asks; a null source is one of its own, texts without a word weigh nothing."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every row taken; a null text has no token."""
    return bpe.encode_documents(docs, WORD_BPE, with_ids=True)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", weights), ("bpe", tokens)]

#: SQL can't express the language model, the fingerprints or the merges; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
