"""A corpus pipeline over documents: five stages, each written as Parquet and read again by the next.

1. quality      documents that the quality classifier rejects go
2. similar      of documents that are near copies of each other, the one with the least id stays
3. clean        documents that hold ten words in a row of a benchmark item go
4. private      personal data is replaced by its kind
5. mix          sources are drawn to their target weights; mix_words and mix_shards say how often and where

Each stage learns from, and decides on, all that its predecessor kept. Nulls, empty texts and repeated rows are
treated as the stages' operators say; a null or empty text is scored like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import decontaminate, mixing, pii, quality, similar
from ledgerlight.llm.store import durable, mark, release


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", keep_good), ("similar", keep_one), ("clean", keep_clean), ("private", redact), ("mix", mix)]

#: Stages that train models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, began, keep=1)  # what the stage needed on its way, and its predecessor's table
    return docs
