"""Corpus pipeline: quality rules, exact dedup, near dedup, packing; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm.common import stored
from rillwork.llm.exact_dedup import drop_copies
from rillwork.llm.near_dedup import drop_near_copies
from rillwork.llm.packing import pack_documents
from rillwork.llm.quality import clean

#: SQL can't express the signatures, the least-squares plan or the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lose at most half of their words to failed lines; their texts go on without those lines."""
    return clean(docs, remove_lines=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return drop_near_copies(docs, shingle=5, num=80, den=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
