"""File sinks. All write through Spark, partitioned by what readers look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators.retrieval import Bm25


def save_index(chunks: DataFrame, vectors: DataFrame, folder: str) -> None:
    """Chunks, vectors, postings and document frequencies; postings are clustered by term, so that a query's terms
    prune row groups. Vectors must agree in length, which one aggregate checks before anything is written."""
    if vectors.agg(F.count_distinct(F.size("v"))).first()[0] > 1:
        raise ValueError("vectors of several lengths")
    index = Bm25(chunks, "chunk_id")
    for name, frame in (("chunks", chunks), ("vectors", vectors), ("postings", index.postings().repartitionByRange("term").sortWithinPartitions("term", "id")), ("idf", index.idf)):
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "vectors", "postings", "idf")}


def save_records(records: DataFrame, folder: str) -> None:
    """Records as JSON and their retrieval texts, by lender."""
    named = records.withColumn("slug", R.slug())
    named.write.mode("overwrite").partitionBy("bank").json(f"{folder}/records")
    named.select("bank", R.rag_text().alias("value")).write.mode("overwrite").partitionBy("bank").text(f"{folder}/texts")


def save_summary(records: DataFrame, folder: str) -> None:
    R.summary(records).coalesce(1).write.mode("overwrite").json(folder)  # a row a lender


def save_chunks(chunks: DataFrame, folder: str) -> None:
    chunks.write.mode("append").partitionBy("source").json(folder)


def remember(seen: DataFrame, folder: str) -> None:
    """Appends `h:` and `u:` lines for (content_hash, source_url)."""
    lines = F.explode(F.array(F.concat(F.lit("h:"), "content_hash"), F.concat(F.lit("u:"), "source_url")))
    seen.select(lines.alias("value")).filter("value is not null").distinct().write.mode("append").text(folder)


def memoised(uploads: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads split into those with a stored result for their content and query, and new ones."""
    key = ["file_hash", "query"]
    return uploads.join(results, key), uploads.join(results.select(*key), key, "left_anti")


def save_artefacts(analysed: DataFrame, folder: str) -> None:
    """What was made of uploads (file_hash, raw_text, structured, result), each kind under its content's hash."""
    for kind in ("raw_text", "structured", "result"):
        analysed.select("file_hash", F.col(kind).cast("string").alias("value")).filter("value is not null").write.mode("append").partitionBy("file_hash").text(f"{folder}/{kind}")


def save_cache(entries: DataFrame, folder: str) -> None:
    """Cached answers; the newest entry of a key stays."""
    newest = entries.groupBy("key").agg(F.max_by(F.struct(*entries.columns), "first_ts").alias("_e"))
    newest.select("_e.*").write.mode("overwrite").parquet(folder)


def save_apart(records: DataFrame, folder: str) -> tuple[int, int]:
    """Records as JSON texts, those that can't be told (no address, no lender) under `failed`, so that one bad record
    stops no other. How many of each."""
    named = records.withColumn("failed", (F.coalesce(F.col("source_url"), F.lit("")) == "") | (F.coalesce(F.col("bank"), F.lit("")) == ""))
    named.select("failed", F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").partitionBy("failed").text(folder)
    counts = {r.failed: r["count"] for r in named.groupBy("failed").count().collect()}
    return counts.get(False, 0), counts.get(True, 0)
