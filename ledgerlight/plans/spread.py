"""How rows are dealt over cores, and which side of a join is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs of up to so many bytes are dealt over all cores; sides of up to so many rows are broadcast.
SMALL_BYTES, SMALL_ROWS = 64 << 20, 100_000
#: For rows that take much work: splits a core that a scan must have to be left alone, and bytes a part that is dealt.
ENOUGH_SPLITS, PART_BYTES = 4, 8 << 20
_LIMIT, _UNSET, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def _size(rows: DataFrame) -> int:
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they are few bytes: a small file has one row group or two, so that its scan would leave
    most cores idle. Larger inputs have row groups enough and are not shuffled."""
    return rows.repartition(_parts(rows.sparkSession)) if _size(rows) <= SMALL_BYTES else rows


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows over all cores, or so many parts, for steps in which a row takes much more work than reading it: a file of hundreds of
    megabytes can still have one row group or two. Only inputs of many splits a core are left as they are read. Rows
    should be narrow here: what can be made of them is made after they are dealt."""
    spark, size = rows.sparkSession, _size(rows)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size > ENOUGH_SPLITS * spark.sparkContext.defaultParallelism * split:
        return rows
    return rows.repartition(parts or max(_parts(spark), -(-size // PART_BYTES)))


def batches_by_bytes(spark: SparkSession) -> None:
    """Bounds what goes to Python at once; Spark's own limit is far above what a worker should hold. A limit that the
    session sets is kept."""
    if spark.conf.get(_LIMIT) == _UNSET:
        spark.conf.set(_LIMIT, f"{BATCH_BYTES}b")


def _parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(side: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """side, broadcast if it has most rows at most; beyond that Spark joins it by a shuffle. Counting stops there."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
