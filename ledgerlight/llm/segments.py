"""Segments: bounded packs of whole documents, and exchanges of packed keys between them.

Operators that compare all documents by hashed keys would shuffle hundreds of rows for each document. Instead
documents are packed into segments of bounded size; a segment sends each bucket of the key space one row that
holds the segment's distinct keys as a compressed array, and gets one row of answers back. A key costs at most
one entry per segment, however often it occurs, so no key can fill a task.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import expand, squeeze
from .store import bucketed, by_bytes, durable, partitions

#: Bytes of text in a segment (a longer document is a segment of its own), and bytes of text whose keys one bucket
#: answers for, on average. An exchange has at most (bytes / segment) * (bytes / bucket) rows, so both grow with the
#: executors' memory and the input: spark.ledgerlight.segmentBytes and spark.ledgerlight.bucketBytes set them. These
#: values suit workers of half a gigabyte.
SEGMENT_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Stands for a null id: larger than every id that compares.
NO_ID = np.iinfo(np.int64).max


def trim() -> None:
    """Hands freed memory back to the system: a worker lives on after a task, and what its allocators keep counts
    against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library



def slices(texts: pa.Array, cap: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts (strings or binaries) of cap bytes, about; a longer text is a run of its own."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + cap)))
        yield a, z
        a = z


SCHEMA = "seg long, ids array<bigint>, lens array<int>, raw long, blob binary"


def packs(batches: Iterator[pa.RecordBatch], cap: int = SEGMENT_BYTES) -> Iterator[tuple[list, list, bytes]]:
    """(ids, byte lengths or None for null texts, texts each followed by a line feed) of bounded size."""
    ids, lens, parts, size = [], [], [], 0
    for b in batches:
        for a, z in slices(b.column(1), cap):
            for i, t in zip(b.column(0).slice(a, z - a).to_pylist(), b.column(1).slice(a, z - a).to_pylist(), strict=True):
                ids.append(i)
                lens.append(None if t is None else len(t))
                parts.append(t or b"")
                size += len(parts[-1]) + 1
                if size >= cap:
                    yield ids, lens, b"\n".join([*parts, b""])
                    ids, lens, parts, size = [], [], [], 0
    if ids:
        yield ids, lens, b"\n".join([*parts, b""])


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that packs() reads, whatever else docs holds."""
    return by_bytes(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _squeezed(lens: list, blob: bytes) -> bytes:
    return squeeze(blob)


def _pack(batches, cap, form):
    base = TaskContext.get().partitionId() << 32
    for k, (ids, lens, blob) in enumerate(packs(batches, cap)):
        yield pa.RecordBatch.from_pydict({"seg": [base + k], "ids": pa.array([ids], pa.list_(pa.int64())), "lens": pa.array([lens], pa.list_(pa.int32())), "raw": [len(blob)], "blob": pa.array([form(lens, blob)], pa.binary())})


class Segments:
    """Packed documents in the shared folder, bucketed by segment, with the number of key buckets that suits them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = 2, form: Callable[[list, bytes], bytes] = _squeezed):
        """spread: least buckets for each partition of a shuffle; more of them are smaller. form: what is stored of the
        byte lengths and texts of a segment, if not the texts."""
        spark = docs.sparkSession
        cap, each = (int(spark.conf.get(f"spark.ledgerlight.{k}Bytes", str(v))) for k, v in (("segment", SEGMENT_BYTES), ("bucket", BUCKET_BYTES)))
        self.df = bucketed(texts_of(docs, id_col, text_col).mapInArrow(lambda b: _pack(b, cap, form), SCHEMA), "segments", "seg", partitions(spark))
        total = self.df.agg(F.sum("raw")).first()[0] or 0
        self.buckets = max(spread * partitions(spark), -(-total * spread // (2 * each)))

    def emit(self, fn: Callable[[Seg, int], Iterator[dict]], schema: str) -> DataFrame:
        """Rows that fn makes of each segment by itself."""
        buckets = self.buckets

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    yield from _out(fn(Seg(row), buckets), schema)
                    trim()

        return self.df.mapInArrow(run, schema)

    def with_answers(self, answers: DataFrame, fn: Callable[[Seg, list[dict], int], Iterator[dict]], schema: str) -> DataFrame:
        """Rows that fn makes of each segment and the answers with its seg, ordered by bucket."""
        buckets = self.buckets

        def run(key, left, right):
            rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
            for row in left.to_pylist():
                yield from _out(fn(Seg(row), rows, buckets), schema)

        def table(key, left, right):
            out = pa.Table.from_batches(run(key, left, right), schema=_arrow(schema))
            trim()
            return out

        return self.df.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(table, schema)


class Seg:
    """One segment in a task."""

    def __init__(self, row: dict):
        self.seg = row["seg"]
        self.ids = row["ids"]
        self.null = np.array([x is None for x in row["lens"]])
        self.lens = np.array([x or 0 for x in row["lens"]], np.int64)
        self.order = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        self.stored = row["blob"]
        self.starts = np.cumsum(self.lens + 1) - self.lens - 1

    @functools.cached_property
    def blob(self) -> np.ndarray:
        return np.frombuffer(expand(self.stored), np.uint8)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "float": pa.float32()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))])


def _out(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """Each dict holds a value, or for many rows a list or array, for each column."""
    to = _arrow(schema)
    for r in rows:
        cols = {k: v if isinstance(v, (list, np.ndarray)) else [v] for k, v in r.items()}
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in to], schema=to)


def by_bucket(emitted: DataFrame, fn: Callable[[list[dict]], Iterator[dict]], schema: str, tag: str, buckets: int) -> DataFrame:
    """What fn makes of all rows of each bucket, in the shared folder. Rows come in the order of seg. The number of
    partitions is stated, as compressed buckets look small to AQE, which would put many into one task."""

    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        del table
        out = pa.Table.from_batches(_out(fn(rows), schema), schema=_arrow(schema))
        trim()
        return out

    return durable(emitted.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, schema), tag)


def split(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets, which are equal ranges of uint64, in ascending keys: bucket b is [at[b], at[b + 1])."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))
