"""The registered queries of this subpackage: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunks, decontaminate, langid, mixing, neighbours, ngrams, pii, quality, repeats, similar
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.classes(_table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_suffix_dedup, op3_lm_score, op4_pii, op5_chunk_dedup, op6_language, op7_similar, op8_mix, op9_quality, op10_neighbours)}

__all__ = ["ORACLES", "QUERIES"]
