"""Bounded, repeatable samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

_SPACE = 1 << 30
#: Bytes of text that a sample brings to the driver, at most.
BYTES = 128 << 20


def _hashed(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(_SPACE))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def per_class(rows: DataFrame, label: str, key: str, each: int, classes: int) -> DataFrame:
    """About each rows of every class (of the most frequent classes), those whose key hashes lowest; fewer where a
    class has fewer. What comes back is bounded by each * classes, up to the chance of the hash."""
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(classes)
    share = {r[label]: min(1.0, each / r["count"]) for r in counts.collect()}
    if not share:
        return rows.limit(0)
    limit = F.lit(0)
    for value, s in sorted(share.items()):
        limit = F.when(F.col(label) == F.lit(value), F.lit(int(s * _SPACE))).otherwise(limit)
    return rows.filter(_hashed(key) < limit)


def bounded(rows: DataFrame, key: str, text: str, most: int, most_bytes: int = BYTES) -> DataFrame:
    """Of a sample the most rows whose key and text hash lowest, as far as their texts take most_bytes together (one row
    at least): whatever repeats or is long, no more comes to the driver."""
    few = rows.withColumn("_hash", F.xxhash64(F.lit("sample"), key, text)).orderBy("_hash", key, text).limit(most)
    upto = W.Window.orderBy("_hash", key, text).rowsBetween(W.Window.unboundedPreceding, 0)  # at most so many rows
    return few.withColumn("_upto", F.sum(F.coalesce(F.octet_length(text), F.lit(0))).over(upto)).withColumn("_nth", F.row_number().over(upto)).filter((F.col("_upto") <= most_bytes) | (F.col("_nth") == 1)).drop("_hash", "_upto", "_nth")


def fair_share(counts: list[int], each: int, total: int) -> int:
    """The most rows a class, each at most and one at least, at which all classes together give total at most."""
    n = np.sort(np.array(counts, np.int64))
    below = np.cumsum(n) - n
    left = len(n) - np.arange(len(n))
    fits = below + n * left <= total  # if every class gives at most the k-th smallest count
    k = int(np.argmin(fits)) if not fits.all() else len(n)
    return each if k == len(n) else max(1, min(each, int((total - below[k]) // left[k])))


def every_class(rows: DataFrame, label: str, key: str, each: int, total: int) -> DataFrame:
    """About each rows of every class, those whose key hashes lowest; of the larger classes fewer where all together
    are more than total, but of no class none. What comes back is bounded by total or, if that is more, by a few rows
    a class."""
    hashed = _hashed(key)
    found = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(hashed).alias("lowest")).collect()
    if not found:
        return rows.limit(0)
    most = fair_share([r["n"] for r in found], each, total)
    limits = [(r[label], max(int(min(1.0, most / r["n"]) * _SPACE), r["lowest"] + 1)) for r in found]
    schema = T.StructType([T.StructField("_class", rows.schema[label].dataType), T.StructField("_limit", T.LongType())])
    small = F.broadcast(rows.sparkSession.createDataFrame(limits, schema))  # a row for each class
    return rows.join(small, F.col(label) == F.col("_class")).filter(hashed < F.col("_limit")).drop("_class", "_limit")
