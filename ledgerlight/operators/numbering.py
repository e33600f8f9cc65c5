"""Sequential numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def number(rows: DataFrame, major: str, key: str, span: int = 1 << 20, name: str = "idx") -> DataFrame:
    """rows numbered from 0 by (major, key), key a whole number: rows are numbered inside blocks of span keys, and the
    blocks' sizes, a small table, give the offsets."""
    blocked = rows.withColumn("_block", F.floor(F.col(key) / span))
    sizes = blocked.groupBy(major, "_block").agg(F.count("*").alias("_n"))
    before = W.Window.orderBy(major, "_block").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(major).alias("_major"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = blocked.withColumn("_i", F.row_number().over(W.Window.partitionBy(major, "_block").orderBy(key)))
    return inside.join(offsets, (F.col(major) == F.col("_major")) & (F.col("_block") == F.col("_b"))).withColumn(name, F.col("_offset") + F.col("_i") - 1).drop("_block", "_b", "_major", "_offset", "_i")
