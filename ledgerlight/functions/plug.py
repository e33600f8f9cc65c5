"""Services that are plugged in: encoders, rerankers, writers. The defaults are deterministic and offline."""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..operators.retrieval import tokens

Encoder = Callable[[list[str]], np.ndarray]


def hashed(text: Column, dims: int = 64) -> Column:
    """The default encoder: signed hashed word counts, of unit length, in columns alone."""
    w = tokens(text)
    at = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(dims)))
    sign = F.transform(w, lambda x: F.when(F.pmod(F.hash(x), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.arrays_zip(at.alias("at"), sign.alias("sign"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(pairs, lambda p: p["at"] == d), F.lit(0.0), lambda a, p: a + p["sign"]))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x)) + 1e-10
    return F.transform(sums, lambda x: (x / norm).cast("float"))


def encoder(encode: Encoder, batch: int = 32) -> Callable[[Column], Column]:
    """A plugged-in encoder as a column function: Arrow batches, cut into batches of the encoder's size, normalised."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        parts = [encode(texts.iloc[k : k + batch].fillna("").tolist()) for k in range(0, len(texts), batch)]
        x = np.concatenate(parts) if parts else np.zeros((0, 1))
        return pd.Series(list((x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)).astype(np.float32)))

    return run


class Fatal(Exception):
    """Raised by an encoder that will not work however often it is asked (an unknown model, say)."""


def patient(encode: Encoder, tries: int = 3, first_wait: float = 2.0, wait: Callable[[float], None] = time.sleep) -> Encoder:
    """An encoder that is asked again after 2, 4, 8, ... seconds, but not after a fatal answer."""

    def run(texts: list[str]) -> np.ndarray:
        for k in range(tries):
            try:
                return encode(texts)
            except Fatal:
                raise
            except Exception:
                if k == tries - 1:
                    raise
                wait(first_wait * 2**k)
        raise AssertionError

    return run


def first_working(encoders: dict[str, Encoder], probe: str = "probe") -> tuple[str, int, Encoder]:
    """Name, dimensions and function of the first encoder that encodes a probe."""
    for name, encode in encoders.items():
        try:
            return name, int(np.asarray(encode([probe])).shape[1]), encode
        except Exception:  # an encoder that can't be had; the next one is asked
            continue
    raise RuntimeError("no encoder works")


def for_each_record(records: DataFrame, then: Callable[[dict], None]) -> None:
    """Calls then with each record, where the records are; what it raises stops only that record."""

    def run(rows):
        for r in rows:
            try:
                then(r.asDict(recursive=True))
            except Exception:
                continue

    records.foreachPartition(run)


def availability(spark, modules: tuple[str, ...] = ("pandas", "pyarrow", "yaml", "numpy")) -> DataFrame:
    """name, available: optional parts that this installation can use."""
    return spark.createDataFrame([(m, importlib.util.find_spec(m) is not None) for m in modules], "name string, available boolean")


def rerank(ranked: DataFrame, score: Callable[[Column, Column], Column] | None, query: str, text: str, top: int, least_words: int = 4) -> DataFrame:
    """The best top rows of each query by a plugged-in score, with it scaled to [0, 1] over the query's candidates.
    Without a score, for a query of fewer than least_words words, or where there are no more than top candidates, the
    order stays. Candidates that the score has nothing to say of come behind the others, in their order."""
    from ..operators.retrieval import minmax

    if score is None:
        return ranked.filter(F.col("rank") <= top)
    few = F.regexp_count(F.col(query), F.lit("\\S+")) < least_words
    n = F.count("*").over(W.Window.partitionBy("query_id"))
    judged = ranked.withColumn("_keep", few | (n <= top)).withColumn("score", F.when(~F.col("_keep"), score(F.col(query), F.col(text))))
    order = W.Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    best = minmax(judged).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.withColumn("score", F.col("scaled")).drop("_keep", "scaled")


def explanation(decision: Column, best: Column, confidence: Column) -> Column:
    """The default writer: a sentence from a template."""
    return F.concat_ws(" ", F.concat(F.lit("Decision: "), decision, F.lit(".")), F.concat(F.lit("Best match: "), best, F.lit(".")), F.concat(F.lit("Confidence "), F.format_string("%.2f", confidence), F.lit(".")))


def parsed_answer(answer: Column, schema: str) -> Column:
    """JSON that a writer returned, without fences; null where it can't be read."""
    return F.from_json(F.trim(F.regexp_replace(answer, "```(?:json)?", "")), schema)
