"""Stateful operators: in batch form, and as Structured Streaming queries with the same results.

The streaming forms read a folder or file as a stream with availableNow, so they end; their state and checkpoints live
in the session's shared folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def carried(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Session memory: each field's last known value up to the row."""
    w = W.Window.partitionBy(*key).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def windows(events: DataFrame, width: str, at: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with a slide an event is in several windows."""
    return events.groupBy(F.window(at, width, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp()
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream, so many files a batch; its time column as an instant."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    s = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{name}*")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """The stream, run until its input ends, written as Parquet and read back. In update mode each batch is a folder of
    its own, which a repeated batch replaces, and what holds of a key is its row in the last batch that has it."""
    spark = stream.sparkSession
    where = _shared(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{where}/out")
    write = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/{number}")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/state").outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{where}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_row")).select("_row.*")


def stream_windows(spark: SparkSession, path: str, width: str, late: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return _run(windows(_source(spark, path).withWatermark("ts", late), width), "append")


def stream_distinct(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The first event of each key."""
    return _run(_source(spark, path).dropDuplicates(keys).select(*keys), "append")


def stream_memory(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A running profile of each user, kept as custom state."""

    def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            n, last = n + len(b), max(last, int(b["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_id": [last]})

    s = _source(spark, path, files).select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(remember, "user_id long, n long, last_id long", "n long, last_id long", "update", GroupStateTimeout.NoTimeout)
    return _run(s, "update", "user_id")


#: How long an answer stays in the cache, and the version of its keys; entries of another version count as absent.
TTL_SECONDS, VERSION = 6 * 3600, "v3.4:"


def stream_cache(spark: SparkSession, path: str, ttl: int = TTL_SECONDS, files: int | None = None) -> DataFrame:
    """key, hits, misses: events ask a cache under their key; the first one sets an entry, later ones hit it until it is
    ttl seconds old, then the next one sets it anew. What is kept of a key is one time and two counts. Within a batch
    events are asked in their order."""

    def ask(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, hits, misses = state.get if state.exists else (None, 0, 0)
        times = sorted(int(t) for b in batches for t in b["at"])
        for t in times:
            if since is not None and t - since < ttl:
                hits += 1
            else:
                since, misses = t, misses + 1
        state.update((since, hits, misses))
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "misses": [misses]})

    keyed = _source(spark, path, files).select(F.concat(F.lit(VERSION), F.col("event_type"), F.lit(":"), (F.col("user_id") % 40).cast("string")).alias("key"), F.unix_seconds("ts").alias("at"))
    s = keyed.groupBy("key").applyInPandasWithState(ask, "key string, hits long, misses long", "since long, hits long, misses long", "update", GroupStateTimeout.NoTimeout)
    return _run(s, "update", "key")
