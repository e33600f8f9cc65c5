"""Shared-folder storage: tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.spread import spread


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
_LIMIT, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, one of our own if all of Spark runs on
    this machine; on a cluster a folder of our own would be another one on each machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerlight-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back. Later stages never recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")  # what the query shuffled is in the table now
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Like durable(), but bucketed by key, so that later joins and co-groups on key do not shuffle this side."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    _WRITTEN.append(f"{shared_dir(spark)}/{name}")
    _TABLES.append(name)
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def by_bytes(df: DataFrame) -> DataFrame:
    """df, whose rows shall go to Python in batches of BATCH_BYTES; a small table is dealt over all cores first. Spark's
    own limit is far above what a worker should hold; a limit that the session sets is kept."""
    if df.sparkSession.conf.get(_LIMIT) == _UNSET:
        df.sparkSession.conf.set(_LIMIT, f"{BATCH_BYTES}b")
    return spread(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mark() -> tuple[int, int]:
    """How much this process has written so far; see release()."""
    return len(_WRITTEN), len(_TABLES)


def release(spark: SparkSession, since: tuple[int, int] = (0, 0), keep: int = 0) -> None:
    """Removes what this process has written to the shared folder since a mark, but for the last keep folders. Results
    that still read it are gone with it, so call this when they have been saved."""
    jvm = spark.sparkContext._jvm
    paths, names = _WRITTEN[since[0] :], _TABLES[since[1] :]
    kept = paths[len(paths) - keep :] if keep else []
    for name in names:
        spark.sql(f"drop table if exists {name}")
    for path in paths[: len(paths) - keep]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[since[0] :] = kept
    del _TABLES[since[1] :]
