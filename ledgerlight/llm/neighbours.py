"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue for all of them.

Each tree halves a bounded sample again and again by the plane between two of its vectors; vectors of different
lengths have forests of their own. Every row is filed under its leaf in every tree. A query walks all trees at once through a queue ordered by how near it stands to the planes
that it would have to cross, until it has opened leaves enough; the rows filed there are ranked by exact cosine in
double precision. Leaves with many rows (a vector that repeats, say) are dealt out by a hash over several groups, and
the queries that open a leaf over several blocks: each group meets each block in a cell of its own, so that neither many
rows nor many queries fill a task. Trees are asked one after the other where the table is large, which bounds what is
shuffled at once.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Vectors are
first divided by a power of two near their largest component, so that the squares of very large and very small ones
stay finite; a cosine does not change by that. A query finds only vectors of its own length. Repeated rows are
candidates each for itself, but those with the query's own id; a repeated query is answered as often as it occurs.
Ties go to the smaller id. Empty tables give no rows; extra columns, under any name, are not read. A vector is short,
whatever a table holds: long ones mean fewer rows a group.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import every_class, fair_share
from .segments import trim
from .store import BATCH_BYTES, by_bytes, durable

#: Vectors that the planes are drawn from, at most (up to the chance of a hash), and bytes that these take; the planes,
#: which every worker holds, take about as many.
SAMPLE, SAMPLE_BYTES = 16384, 32 << 20
TREES, LEAF_ROWS, NEAREST = 4, 256, 5
#: Share of the sample's own nearest neighbours that its queries must meet in the leaves they open, and how many
#: sampled queries measure it. The queue then opens as many leaves as that took.
RECALL, MEASURED = 0.97, 128
#: Fewest sampled vectors of a leaf, and rows of a group and queries of a block, about; the vectors of either take
#: GROUP_BYTES. TOGETHER queries are ranked at once.
LEAF_SAMPLE, GROUP_ROWS, GROUP_BYTES, TOGETHER = 4, 4096, 32 << 20, 32
#: Bytes of vectors, each counted once a tree, up to which all trees are asked at once.
AT_ONCE_BYTES = 256 << 20


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two that brings their largest component into [0.5, 1); exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass
class Tree:
    """Nodes in arrays; a leaf is ~number where a child would be."""

    normal: list[np.ndarray] = field(default_factory=list)
    offset: list[float] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, least: int, rng: np.random.Generator) -> int:
        """Grows below the sampled vectors x without recursion; returns the root."""
        root: list[list[int]] = [[0]]
        todo = [(x, root[0], 0)]
        while todo:
            some, parent, slot = todo.pop()
            cut = self._plane(some, rng) if len(some) > least else None
            if cut is None:
                parent[slot] = ~self.leaves
                self.leaves += 1
                continue
            normal, offset, right = cut
            parent[slot] = len(self.child)
            self.normal.append(normal)
            self.offset.append(offset)
            self.child.append([0, 0])
            todo += [(some[~right], self.child[-1], 0), (some[right], self.child[-1], 1)]
        return root[0][0]

    @staticmethod
    def _plane(some: np.ndarray, rng: np.random.Generator):
        for _ in range(8):
            a, b = some[rng.integers(len(some), size=2)]
            normal = a - b
            size = np.sqrt(normal @ normal)
            if size > 1e-9:
                normal /= size
                side = some @ normal
                offset = float(np.median(side))
                right = side > offset
                if 0 < right.sum() < len(some):
                    return normal, offset, right
        return None


class Forest:
    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 3):
        rng = np.random.default_rng(seed)
        least = max(LEAF_SAMPLE, leaf_rows * len(sample) // max(rows, 1))
        unit = units(sample)
        self.trees = [Tree() for _ in range(trees)]
        self.roots = [t.grow(unit, least, rng) for t in self.trees]
        for t in self.trees:
            t.normal = np.array(t.normal).reshape(-1, sample.shape[1])
            t.offset = np.array(t.offset)
            t.child = np.array(t.child, np.int64).reshape(-1, 2)
        self.first = np.cumsum([0, *(t.leaves for t in self.trees)])  # leaves are numbered through

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each unit vector in each tree."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for k, (t, root) in enumerate(zip(self.trees, self.roots, strict=True)):
            node = np.full(len(x), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                n = node[live]
                node[live] = t.child[n, ((x[live] * t.normal[n]).sum(1) > t.offset[n]).astype(int)]
                live = live[node[live] >= 0]
            out[:, k] = ~node + self.first[k]
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float) -> int:
        """How many leaves a query must open. Neighbours in the sample stand farther off than those in all rows, so
        the share met among all rows is the higher one."""
        x = units(sample)
        leaves, met = self.leaves_of(x), []
        for i in range(0, len(x), max(1, len(x) // MEASURED)):
            order = np.empty(self.first[-1], np.int64)
            order[self.probe(x[i], self.first[-1])] = np.arange(self.first[-1])
            near = x @ x[i]
            near[i] = -2
            met += order[leaves[np.argpartition(-near, min(k, len(x) - 1))[: min(k, len(x) - 1)]]].min(1).tolist()
        return int(np.quantile(met, recall, method="higher")) + 1 if met else int(self.first[-1])

    def probe(self, q: np.ndarray, probes: int) -> list[int]:
        """The leaves that a unit vector opens, nearest first over all trees."""
        sides = [t.normal @ q - t.offset for t in self.trees]
        queue = [(0.0, k, root) for k, root in enumerate(self.roots)]
        heapq.heapify(queue)
        out: list[int] = []
        while queue and len(out) < probes:
            far, k, node = heapq.heappop(queue)
            t = self.trees[k]
            while node >= 0:
                side = float(sides[k][node])
                heapq.heappush(queue, (max(far, abs(side)), k, int(t.child[node, int(side <= 0)])))
                node = int(t.child[node, int(side > 0)])
            out.append(int(~node + self.first[k]))
        return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, an array of floats if the column is one and else of doubles, of the rows that take part."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).filter("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float, copy=False) if len(flat) else np.zeros((0, 1))


def deal(batches, first: np.ndarray, groups: np.ndarray, blocks: np.ndarray, asking: bool, most: int = BATCH_BYTES):
    """Rows or, if asking, queries, once for each cell that they go to. The cells of a leaf begin at first[leaf], a cell
    for each of its groups and blocks: a row goes to one group and all blocks, a query to one block and all groups. What
    is handed on at once has about most bytes, whatever a batch and a leaf hold."""
    own, across = (blocks, groups) if asking else (groups, blocks)
    for b in batches:
        row, leaf = b.column(0).to_numpy(), b.column(3).flatten().to_numpy()
        at = np.repeat(np.arange(len(row)), pc.list_value_length(b.column(3)).to_numpy())
        some = np.flatnonzero(across[leaf])
        if not len(some):
            continue
        leaf, at = leaf[some], at[some]
        salt = (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % own[leaf]
        upto = np.cumsum(across[leaf])
        step = max(1, most // (24 + 8 * pc.max(pc.list_value_length(b.column(2))).as_py()))
        for a in range(0, int(upto[-1]), step):
            nth = np.arange(a, min(a + step, int(upto[-1])))
            entry = np.searchsorted(upto, nth, side="right")
            nth += across[leaf[entry]] - upto[entry]
            group, block = (nth, salt[entry]) if asking else (salt[entry], nth)
            rest = pa.array(at[entry])
            yield pa.RecordBatch.from_arrays([pa.array(first[leaf[entry]] + group * blocks[leaf[entry]] + block), *(b.column(c).take(rest) for c in range(3))], names=["cell", "row", "vec_id", "v"])


#: A found row: how far (minus the cosine), its id, its number.
_HIT = np.dtype([("far", "<f8"), ("vec_id", "<i8"), ("row", "<i8")])
_BEST = "query bigint, query_id bigint, best binary"
FOUND = "query_id bigint, rank int, vec_id bigint, score double"


class Forests:
    """A forest for each length of vectors; leaves are numbered through all of them."""

    def __init__(self, drawn: list[np.ndarray], counts: dict[int, int], k: int, trees: int, recall: float, leaf_rows: int):
        self.of: dict[int, tuple[Forest, int, int]] = {}
        self.leaves = 0
        for planes in drawn:
            forest = Forest(planes, counts[planes.shape[1]], trees, leaf_rows)
            self.of[planes.shape[1]] = forest, self.leaves, forest.calibrate(planes, k, recall)
            self.leaves += int(forest.first[-1])

    def by_length(self, b: pa.RecordBatch, at: int):
        """(places, vectors, forest, number of its first leaf, probes) for each length in column at."""
        lens = pc.list_value_length(b.column(at)).to_numpy()
        for d in np.unique(lens).tolist():
            if d in self.of:
                some = np.flatnonzero(lens == d)
                yield some, _matrix(b.column(at).take(pa.array(some))), *self.of[d]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, trees: int = TREES, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query but those with its id."""
    rows, asks = by_bytes(usable(vectors, id_col, vector_col)), usable(queries, id_col, vector_col)
    counts = {r.d: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()}
    if not counts:
        return vectors.sparkSession.createDataFrame([], FOUND)
    each = fair_share(list(counts.values()), sample, sample)
    sample = max(1, min(sample, sample * SAMPLE_BYTES // sum(8 * d * min(n, each) for d, n in counts.items())))
    drawn = every_class(rows.withColumn("d", F.size("v")), "d", "vec_id", sample, sample).orderBy("d", "vec_id").toArrow()
    lens = drawn["d"].to_numpy()
    planes = [np.unique(_matrix(drawn["v"].take(pa.array(np.flatnonzero(lens == d)))), axis=0) for d in np.unique(lens).tolist()]
    forests = Forests(planes, counts, k, trees, recall, leaf_rows)

    def file(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            leaves = np.empty((b.num_rows, trees), np.int64)
            for some, x, forest, first, _ in forests.by_length(b, 1):
                leaves[some] = forest.leaves_of(units(x)) + first
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), b.column(1), pa.array(list(leaves), pa.list_(pa.int64()))], names=["row", "vec_id", "v", "leaves"])
            row += b.num_rows

    def ask(batches):
        """Like file(), with the leaves that a query opens, a part of a batch at a time: it may open very many."""
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for some, x, forest, first, probes in forests.by_length(b, 1):
                step = max(1, BATCH_BYTES // (8 * (probes + x.shape[1])))
                for i in range(0, len(x), step):
                    opened = [np.array(forest.probe(q, probes), np.int64) + first for q in units(x[i : i + step])]
                    at = pa.array(some[i : i + step])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(opened))), b.column(0).take(at), b.column(1).take(at), pa.array(opened, pa.list_(pa.int64()))], names=["row", "vec_id", "v", "leaves"])
                    row += len(opened)

    def kept(df, fn, tag):
        """The rows with their leaves, and how many each leaf has; the sample bounds the number of leaves."""
        out = durable(df.mapInArrow(fn, f"row bigint, vec_id bigint, v {dict(df.dtypes)['v']}, leaves array<bigint>"), tag)
        held = np.zeros(forests.leaves, np.int64)
        for r in out.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
            held[r.leaf] = r["count"]
        return out, held

    filed, held = kept(rows, file, "filed")
    asked, opened = kept(asks, ask, "asked")
    most, tree = np.empty((2, forests.leaves), np.int64)
    for d, (forest, first, _) in forests.of.items():
        own = slice(first, first + int(forest.first[-1]))
        most[own] = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * d)))
        tree[own] = np.repeat(np.arange(trees), np.diff(forest.first))
    groups, blocks = (np.where((held > 0) & (opened > 0), -(-n // most), 0) for n in (held, opened))
    cell = np.cumsum(groups * blocks) - groups * blocks

    def rank(left, right):
        parts = [np.empty(0, _HIT)]
        ends = [np.zeros(1, np.int64)]
        if left.num_rows and right.num_rows:
            r, q = scaled(_matrix(left["v"])), scaled(_matrix(right["v"]))
            ids, row, own = left["vec_id"].to_numpy(), left["row"].to_numpy(), right["vec_id"].to_numpy()
            norm, norm_q = np.sqrt((r * r).sum(1)), np.sqrt((q * q).sum(1))
            unit, m = r / norm[:, None], min(k, len(r))
            for i in range(0, len(q), TOGETHER):
                near = q[i : i + TOGETHER] / norm_q[i : i + TOGETHER, None] @ unit.T
                near[own[i : i + TOGETHER, None] == ids] = -2
                least = np.partition(near, len(r) - m, axis=1)[:, len(r) - m, None] - 1e-9
                of, at = np.nonzero((near >= least) & (near > -2))
                hits = np.empty(len(at), _HIT)
                for j in range(0, len(at), step := max(1, BATCH_BYTES // (8 * r.shape[1]))):
                    x, y = at[j : j + step], of[j : j + step] + i
                    hits["far"][j : j + step] = -((r[x] * q[y]).sum(1) / (norm[x] * norm_q[y]))  # one order of summation for all, so that copies tie
                hits["vec_id"], hits["row"] = ids[at], row[at]
                count = np.bincount(of, minlength=len(near))
                nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                parts.append(hits[np.lexsort((hits["row"], hits["vec_id"], hits["far"], of))][nth < k])
                ends.append(ends[-1][-1] + np.cumsum(np.minimum(count, k)))
        best = np.concatenate(parts)
        at = np.concatenate(ends).astype(np.int32) * _HIT.itemsize
        lists = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(best.tobytes())])
        trim()
        return pa.table({"query": right["row"][: len(lists)], "query_id": right["vec_id"][: len(lists)], "best": lists})

    def merge(batches):
        """The k best of the lists of each query, as one list; a row that stands in several trees counts once."""
        for b in batches:
            best = []
            for lists in b.column(2).to_pylist():
                hits = np.frombuffer(b"".join(lists), _HIT)
                hits = hits[np.unique(hits["row"], return_index=True)[1]]
                best.append(np.sort(hits, order=("far", "vec_id", "row"))[:k].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.binary())], names=["query", "query_id", "best"])

    def tell(batches):
        for b in batches:
            lists = b.column(2).to_pylist()
            n = np.array([len(x) // _HIT.itemsize for x in lists], np.int64)
            hits = np.frombuffer(b"".join(lists), _HIT)
            rank = np.arange(len(hits)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(1).to_numpy(), n)), pa.array(rank.astype(np.int32)), pa.array(hits["vec_id"]), pa.array(-hits["far"])], names=["query_id", "rank", "vec_id", "score"])

    def merged(found):
        # each list has k entries at most, and a query as many lists as cells that it opens
        return found.groupBy("query").agg(F.first("query_id").alias("query_id"), F.collect_list("best").alias("best")).mapInArrow(merge, _BEST)

    def meet(among):
        """The k best of each cell of some leaves, for each query that goes there."""
        here, there = np.where(among, groups, 0), np.where(among, blocks, 0)

        def dealt(df, asking):
            return df.mapInArrow(lambda b: deal(b, cell, here, there, asking), f"cell bigint, row bigint, vec_id bigint, v {dict(df.dtypes)['v']}").groupBy("cell")

        return dealt(filed, False).cogroup(dealt(asked, True)).applyInArrow(rank, _BEST)

    if sum(8 * d * n * trees for d, n in counts.items()) <= AT_ONCE_BYTES:
        return merged(meet(np.ones(forests.leaves, bool))).mapInArrow(tell, FOUND)
    found = [durable(merged(meet(tree == t)), "found") for t in range(trees)]
    return merged(functools.reduce(DataFrame.unionAll, found)).mapInArrow(tell, FOUND)
