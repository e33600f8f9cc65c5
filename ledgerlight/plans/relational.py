"""Joins by time that need more than an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, seen: str) -> DataFrame:
    """Each left row with the last right time of its key at or before its own.

    Both sides are one stream ordered by time inside the key: one shuffle, no product of a key's rows.
    """
    left = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(at))
    marks = right.select(key, F.col(seen).alias("_seen")).withColumn("_side", F.lit(0)).withColumn("_t", F.col("_seen"))
    w = W.Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.Window.unboundedPreceding, 0)
    both = left.unionByName(marks, allowMissingColumns=True).withColumn(seen, F.last("_seen", ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side", "_t", "_seen")


def within(left: DataFrame, right: DataFrame, key: str, at: str, other: str, seconds: int) -> DataFrame:
    """Left rows with the right rows of their key in the seconds up to their own time (outer).

    Times are cut into bins of that length, and a right row can only match in its own bin or the next: an equality
    join on (key, bin), in which a key's rows meet only near ones.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    near = right.withColumn("_bin", F.explode(F.array(bin_of(other), bin_of(other) + 1))).withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_bin")) & (F.col(other) <= F.col(at)) & (F.col(other) >= F.col(at) - F.expr(f"interval {seconds} seconds"))
    return left.withColumn("_b", bin_of(at)).join(near, on, "left").drop("_b", "_bin", "_key")
