"""Benchmark decontamination with a distributed positional inverted index.

Training documents are indexed once: a segment of the index holds, for each distinct term, its positions in
ascending order. A phrase is found by taking the term with the fewest postings in the segment, shifting its
positions by its offset in the phrase, and intersecting them with the shifted positions of the other terms from
the rarest on. Between two documents a position stays empty, so that no match crosses documents. Proximity
matches use the same lists, nearest postings instead of equal ones.

Nulls and empty texts have no words, no items and no hits. Items without words, or null items, match nothing;
an item without id takes part under the id "null". Repeated items count once; repeated documents give a row
each. An empty table of documents gives no rows, one of items no hits. Long texts are read whole, a segment each. Words
count as equal if their 64-bit hashes are: sums of unrelated weights by place, which no regular build of words defeats.
Columns besides those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import dec, dec_sorted, enc, enc_sorted
from .segments import _out, packs, texts_of, trim
from .store import durable
from .tokens import ALNUM, U64, Words, find, uniques

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once; a longer benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20

INDEX = "seg long, ids array<bigint>, words binary, terms binary, postings binary"
HITS = "seg long, at int, doc_id long, n_words long, spans array<bigint>, items array<string>"
S32 = U64(32)
LOW = U64(0xFFFFFFFF)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of all words of docs, one row a segment, in the shared folder."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for k, (ids, lens, blob) in enumerate(packs(batches)):
            w = Words(np.frombuffer(blob, np.uint8), np.array([x or 0 for x in lens], np.int64), ALNUM)
            terms, _, place = uniques(w.hash)
            position = np.arange(len(place)) + w.doc
            postings = np.sort((place.astype(U64) << S32) | position.astype(U64))
            yield from _out([{"seg": base + k, "ids": [ids], "words": enc(w.counts), "terms": enc_sorted(terms), "postings": enc_sorted(postings)}], INDEX)
            trim()

    return durable(texts_of(docs, id_col, text_col).mapInArrow(run, INDEX), "postings")


class Postings:
    """One segment of the index in a task."""

    def __init__(self, row: dict):
        self.seg, self.ids = row["seg"], row["ids"]
        self.words = dec(row["words"], np.int64)
        self.first = np.cumsum(self.words + 1) - self.words - 1  # position of each document's first word
        self.terms = dec_sorted(row["terms"])
        self.list = dec_sorted(row["postings"])
        self.at = np.searchsorted(self.list, np.arange(len(self.terms) + 1, dtype=U64) << S32)

    def candidates(self, rank: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (rank, offset): every position of the term less the offset; and which pair it is of."""
        n = self.at[rank + 1] - self.at[rank]
        pair = np.repeat(np.arange(len(rank)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.at[rank][pair]
        return (self.list[place] & LOW).astype(np.int64) - offset[pair], pair

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        return find(self.list, (rank.astype(U64) << S32) | position.astype(U64)) >= 0

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


class Phrases:
    """Windows of the items, as padded rows of terms."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        ids, texts = [i for i, _ in items], [t for _, t in items]
        w = Words(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.array([len(t) for t in texts], np.int64), ALNUM)
        self.ids = ids
        first = np.cumsum(w.counts) - w.counts
        n = np.where(w.counts >= window, w.counts - window + 1, np.minimum(w.counts, 1))
        self.item = np.repeat(np.arange(len(ids)), n)
        self.size = np.minimum(w.counts, window)[self.item]
        start = np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n) + first[self.item]
        cols = np.minimum(start[:, None] + np.arange(window), max(len(w.hash) - 1, 0))
        self.terms, place = np.unique(w.hash, return_inverse=True)
        self.grid = place[cols] if len(cols) else np.zeros((0, window), np.int64)


def _search(p: Postings, q: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Exact phrase matches: (row of q, position)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = find(p.terms, q.terms)
    if not len(p.list) or not len(q.item):
        return none
    inside = np.arange(q.grid.shape[1]) < q.size[:, None]
    grid = rank[q.grid]
    live = np.flatnonzero(((grid >= 0) | ~inside).all(1))
    if not len(live):
        return none
    grid, inside = grid[live], inside[live]
    df = np.where(inside, (p.at[1:] - p.at[:-1])[grid], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    rows = np.arange(len(live))
    position, pair = p.candidates(grid[rows, order[:, 0]], order[:, 0])
    keep = position >= 0
    position, pair = position[keep], pair[keep]
    for k in range(1, order.shape[1]):
        col = order[pair, k]
        ok = ~inside[pair, col]
        ok[~ok] = p.has(grid[pair, col][~ok], (position + col)[~ok])
        position, pair = position[ok], pair[ok]
    return live[pair], position


def _found(p: Postings, q: Phrases) -> dict:
    row, start = _search(p, q)
    doc = p.doc_of(start)
    n = len(p.ids)
    spans: list[list[int]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    for d, i in sorted(set(zip(doc.tolist(), q.item[row].tolist(), strict=True))):
        items[d].append(q.ids[i])
    local = start - p.first[doc]
    for d, a, b in sorted(set(zip(doc.tolist(), local.tolist(), (local + q.size[row]).tolist(), strict=True))):
        if spans[d] and a <= spans[d][-1]:
            spans[d][-1] = max(spans[d][-1], b)
        else:
            spans[d] += [a, b]
    return {"seg": [p.seg] * n, "at": list(range(n)), "doc_id": p.ids, "n_words": p.words, "spans": spans, "items": items}


def _blocks(items: DataFrame, id_col: str, text_col: str, cap: int):
    """Bounded blocks of the benchmark, one at a time on the driver."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).filter("t is not null")
    for r in rows.toLocalIterator():
        block.append((r.i, bytes(r.t)))
        size += len(r.t) + 32
        if size >= cap:
            yield block
            block, size = [], 0
    yield block


def find_phrases(index: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, spans (merged hit runs of words: start, end, start, ...), items (ids).

    The benchmark is a stated query set: it goes to the tasks in blocks of block_bytes, so that no task or
    broadcast grows with it. With several blocks, what each finds is united by document.
    """

    def search(block):
        def run(batches):
            q = Phrases(block, window)
            for b in batches:
                for row in b.to_pylist():
                    yield from _out([_found(Postings(row), q)], HITS)

        return index.mapInArrow(run, HITS)

    blocks = _blocks(items, id_col, text_col, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return search(block).drop("seg", "at")
    hits = durable(search(block), "hits")
    while following is not None:  # the driver holds two blocks at most; but for the first, only documents with hits are written
        hits = hits.unionByName(durable(search(following).filter(F.size("items") > 0), "hits"))
        following = next(blocks, None)
    pairs = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(2)), lambda i: F.struct(F.get("all", i).alias("a"), F.get("all", i + 1).alias("b")))
    start = F.expr("array()").cast("array<bigint>")
    join = lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"])))).otherwise(F.concat(acc, F.array(s["a"], s["b"])))
    return (
        hits.groupBy("seg", "at")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        .withColumn("spans", F.when(F.size("all") == 0, start).otherwise(F.aggregate(F.sort_array(pairs), start, join)))
        .select("doc_id", "n_words", "spans", "items")
    )


def find_near(index: DataFrame, phrases: list[tuple[str, str]], slop: int) -> DataFrame:
    """Proximity matches of (id, words) phrases: doc_id, item, anchor (word offset of the rarest term in the
    document) wherever each other term of the phrase has a posting within slop words of it, in any order."""
    schema = "doc_id long, item string, anchor long"

    def run(batches):
        sets = [(i, np.unique(Words(np.frombuffer(t.encode() + b"\n", np.uint8), np.array([len(t.encode())]), ALNUM).hash)) for i, t in phrases]
        for b in batches:
            for row in b.to_pylist():
                p = Postings(row)
                for item, terms in sets:
                    rank = find(p.terms, terms)
                    if not len(rank) or (rank < 0).any():
                        continue
                    rank = rank[np.argsort(p.at[rank + 1] - p.at[rank], kind="stable")]
                    position, _ = p.candidates(rank[:1], np.zeros(1, np.int64))
                    doc = p.doc_of(position)
                    ok = np.ones(len(position), bool)
                    lo, hi = p.first[doc], p.first[doc] + p.words[doc]
                    for r in rank[1:]:
                        # the gap to the next document is one position; clip the search to the document
                        a, z = np.maximum(position - slop, lo), np.minimum(position + slop, hi - 1)
                        at = np.searchsorted(p.list, (U64(r) << S32) | a.astype(U64))
                        got = p.list[np.minimum(at, len(p.list) - 1)]
                        ok &= (at < len(p.list)) & (got >> S32 == U64(r)) & ((got & LOW).astype(np.int64) <= z)
                    n = int(ok.sum())
                    if n:
                        yield from _out([{"doc_id": [p.ids[d] for d in doc[ok]], "item": [item] * n, "anchor": (position - lo)[ok]}], schema)

    return index.mapInArrow(run, schema)


def report(hits: DataFrame) -> DataFrame:
    """The digest of find_phrases(): counts, item ids under sha256, and whether any word is hit."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    hits = hits.withColumn("items", F.array_distinct("items"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    return report(find_phrases(build_index(docs), items, window))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of an item. Rows are told apart by a hash of id and text; all columns pass
    through, under any names."""
    row = F.xxhash64("doc_id", "text")
    name = "_leak_row"
    while name in docs.columns:
        name += "_"
    hits = find_phrases(build_index(docs.select(row.alias("row"), "text"), "row"), items, window)
    found = durable(hits.filter(F.size("items") > 0).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.withColumn(name, row).join(found, name, "left_anti").drop(name)
