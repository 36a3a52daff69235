"""Training corpus from documents: what is toxic, copied or leaked goes, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``docs``, whatever these are; documents map to the operators' issues.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.llm import bpe, decontaminate, neardup, queries, storage, toxicity
from longbox.suite.registry import Tables

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _issues(docs: DataFrame) -> DataFrame:
    """(row, id, description): the operators' names beside the untouched row."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("description"))


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    return queries.batched(Tables(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic.

    It learns from the labelled documents of the given table, not of ``docs``.
    """
    t = _tables(spark, sf_dir)
    learn = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    chain = toxicity.fit(learn, queries.labels(t.labels), queries.CATEGORIES)
    return toxicity.without_toxic(_issues(docs), chain, "toxic").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _tables(spark, sf_dir)
    return neardup.without_near_duplicates(_issues(docs)).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = _tables(spark, sf_dir).benchmark
    return decontaminate.without_contaminated(_issues(docs), benchmark).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of each document."""
    _tables(spark, sf_dir)
    encoded = bpe.encode_descriptions(_issues(docs), VOCABULARY, public_tokenizers.PATTERN)
    return encoded.select(F.col("id").alias("doc_id"), "tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]

# A fitted classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = storage.stored(stage(spark, docs, sf_dir), name)
    return docs
