"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents; the last gives each row its place in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import common, decontaminate, hilbert, jaccard_join, langid, mixing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their own labelled rows; others go."""
    return langid.known_language(docs, langid.training(docs.where(~langid.held_out(F.col("doc_id")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each class of near copies."""
    return jaccard_join.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 13 consecutive words of a benchmark item, nor, of shorter items, one word in twenty."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"), remove="windows")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row, in Hilbert order."""
    return hilbert.document_shards(docs)


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontaminate", without_benchmark), ("mix_sources", mixed), ("hilbert_shards", shards)]

#: No SQL: language models, seeded choices and the curve are beyond it. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
