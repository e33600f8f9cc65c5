"""N-gram Jaccard join with a MinHash LSH forest.

A document is the set of its runs of five words (all its words, if fewer). Documents with equal sets are one class. A
class has a MinHash signature of TREES tries; classes that share a prefix in some trie are candidates. The prefix
starts at the tries' full depth and is shortened until a pair at the threshold meets in some trie with probability
RECALL at least; as a shorter prefix keeps every match of a longer one, this is the forest's descent done at once.
Candidates are joined into components along one edge for each class and prefix, never by pairs. Components are
verified by exact Jaccard; one of more than BLOCK classes is verified by pairs of blocks, so that no task holds more
than two blocks.

A document without words (null, empty, marks only) is a class of its own without links. A null id takes part as every
other document. Repeated rows are copies of each other; the least id of a class names it. A long text is a long set,
never cut. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .segments import _out, slices, trim
from .store import by_bytes, durable
from .tokens import ALNUM, U64, Words, mix

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Classes of a component that are verified at once, and bytes of text read at once.
BLOCK, AT_ONCE = 1024, 1 << 20
#: Candidates of which a table is broadcast; from there on it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of sets that one task verifies, on average.
TASK_BYTES = 8 << 20


def depth_for(similarity: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest prefix with which pairs of this similarity still meet with probability recall."""
    return next((d for d in range(deepest, 1, -1) if 1 - (1 - similarity**d) ** trees >= recall), 1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of words."""
    w = Words(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.array([len(t) for t in texts], np.int64), ALNUM)
    h = np.zeros(len(w.hash), U64)
    odd = U64(0xC2B2AE3D27D4EB4F)
    padded = np.concatenate([w.hash, np.zeros(words, U64)])
    for k in range(words):
        h = h * odd + padded[k : k + len(h)]
    h = mix(h)
    out, at = [], 0
    for n in w.counts.tolist():
        if n >= words:
            out.append(np.unique(h[at : at + n - words + 1]))
        elif n:
            short = U64(n)
            for x in w.hash[at : at + n]:
                short = U64((int(short) * int(odd) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([short], U64)))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out


def digest(s: np.ndarray) -> str | None:
    """Names the class of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None


def prefixes(sets: list[np.ndarray], trees: int, depth: int, seed: int = 17) -> np.ndarray:
    """(sets, trees): the hash of each non-empty set's signature prefix in each trie."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (trees, depth)).astype(U64) * U64(2) + U64(1)
    flip = rng.integers(0, 1 << 63, (trees, depth)).astype(U64)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), trees), U64)
    for t in range(trees):
        h = np.full(len(sets), U64(t + 1))
        for d in range(depth):
            x = (flat ^ flip[t, d]) * odd[t, d]
            low = np.minimum.reduceat(x ^ (x >> U64(29)), at)
            h = mix(h * U64(0x9E3779B97F4A7C15) + low)
        out[:, t] = h
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """anon, key: the id, or for a null id a hash of the text in its place."""
    text = F.col("text").cast("string")
    return by_bytes(docs).select(F.col("doc_id").isNull().alias("anon"), F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text)).alias("key"), text.cast("binary").alias("text"))


def _signed(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    schema = "anon boolean, key bigint, cls string, prefixes array<bigint>"

    def run(batches):
        for b in batches:
            for a, z in slices(b.column(2), AT_ONCE):
                rows = b.slice(a, z - a)
                texts = [t or b"" for t in rows.column(2).to_pylist()]
                sets = shingle_sets(texts, words)
                full = [k for k, s in enumerate(sets) if len(s)]
                found: list = [None] * len(sets)
                if full:
                    for k, p in zip(full, prefixes([sets[k] for k in full], trees, depth).view(np.int64), strict=True):
                        found[k] = p
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([digest(s) for s in sets], pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["anon", "key", "cls", "prefixes"])
            trim()

    return durable(_keyed(docs).mapInArrow(run, schema), "signed")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, sets): sizes of the intersections, by postings: rare members pair by pair, common ones as a product."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    run = np.cumsum(new) - 1
    df = np.bincount(run)
    rare = df[run] <= 16
    out = np.zeros(m * m, np.int64)
    r, o = run[rare], owner[rare]
    for step in range(1, 16):
        hit = np.flatnonzero(r[step:] == r[:-step])
        if not len(hit):
            break
        out += np.bincount(o[hit] * m + o[hit + step], minlength=m * m)
    out = out.reshape(m, m)
    out += out.T
    common = np.flatnonzero(df > 16)
    column = np.full(len(df), -1)
    column[common] = np.arange(len(common))
    c, o = column[run[~rare]], owner[~rare]
    for a in range(0, len(common), 2048):
        some = (c >= a) & (c < a + 2048)
        x = np.zeros((m, min(2048, len(common) - a)), np.float32)
        x[o[some], c[some] - a] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _verified(rows: list[tuple[str, int, int, np.ndarray]], similarity: float, across: bool) -> Iterator[tuple[str, int, str]]:
    """cls, links, root for (cls, copies, block, set); across: rows are compared with those of the other block only.
    Links count documents."""
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])
    sizes = np.array([len(r[3]) for r in rows])
    both = _overlaps([r[3] for r in rows])
    near = both >= similarity * (sizes[:, None] + sizes - both) - 1e-9
    np.fill_diagonal(near, False)
    if across:
        blocks = np.array([r[2] for r in rows])
        near &= blocks[:, None] != blocks
    copies = np.array([r[1] for r in rows])
    links = near @ copies
    root = np.arange(len(rows))
    while True:
        low = np.where(near, root, len(rows)).min(1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    for k, r in enumerate(rows):
        yield r[0], int(links[k]), rows[root[k]][0]


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """anon, key (see _keyed), cls, class_id (the least id of the documents that links join to this one), n_links."""
    signed = _signed(docs, words, trees, depth_for(similarity, recall, trees))
    classes = durable(signed.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("anon", "key")).alias("rep"), F.count("*").alias("copies"), F.first("prefixes").alias("prefixes")), "classes")
    filed = classes.select("cls", F.explode("prefixes").alias("prefix"))
    shared = filed.groupBy("prefix").agg(F.min("cls").alias("root"), F.count("*").alias("n")).filter("n > 1").select("prefix", "root")
    # a class shares at most one root in each trie: it keeps the edge to the least of them, and the others' edges to
    # that one, which are few, as roots are
    hubs = filed.join(shared, "prefix").groupBy("cls").agg(F.array_distinct(F.collect_list("root")).alias("roots"), F.min("root").alias("hub"))
    edges = hubs.select(F.explode(F.array_union("roots", F.array("cls"))).alias("node"), F.col("hub").alias("root")).filter("node <> root").distinct()
    comps = components(edges)
    sizes = comps.groupBy("root").agg(F.count("*").alias("size"))
    wanted = durable(comps.join(sizes, "root").join(classes.select(F.col("cls").alias("node"), "rep", "copies"), "node").select("node", F.col("root").alias("comp"), "size", "copies", F.col("rep.anon").alias("anon"), F.col("rep.key").alias("key")), "wanted")
    n = wanted.count()
    texts = _keyed(docs).join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["anon", "key"])
    links = _links(texts, words, similarity, max(1, n * 4096 // TASK_BYTES))
    far = links.filter("large and cls <> root").select(F.col("cls").alias("node"), "root")
    merged = components(far).withColumnRenamed("root", "top")
    sums = links.groupBy("cls").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    sums = sums.join(merged, F.col("cls") == F.col("node"), "left").select("cls", "links", F.coalesce("top", "root").alias("root"))
    linked = durable(classes.join(sums, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked.join(least, "root").select("cls", "n_links", F.when(~F.col("least.anon"), F.col("least.key")).alias("class_id"), F.col("least").alias("first"))
    return signed.drop("prefixes").join(named, "cls", "left")


def _links(texts: DataFrame, words: int, similarity: float, tasks: int) -> DataFrame:
    """cls, links, root, large: what each unit of work verifies. A unit is many small components, or two blocks of a
    large one."""

    def deal(batches):
        schema = "unit string, comp string, cls string, copies long, block int, large boolean, shingles binary"
        for b in batches:
            for r in b.to_pylist():
                s = shingle_sets([r["text"] or b""], words)[0]
                if digest(s) != r["node"]:
                    continue  # another text under the same id
                k = -(-r["size"] // BLOCK)
                mine = int(r["node"][:12], 16) % k
                units = [f"{r['comp']}:{min(mine, j)}:{max(mine, j)}" for j in range(k)] if k > 1 else [str(int(r["comp"][-12:], 16) % tasks)]
                yield from _out([{"unit": units, **{c: [v] * len(units) for c, v in (("comp", r["comp"]), ("cls", r["node"]), ("copies", r["copies"]), ("block", mine), ("large", k > 1), ("shingles", s.tobytes()))}}], schema)

    dealt = texts.select("text", "node", "comp", "size", "copies").mapInArrow(deal, "unit string, comp string, cls string, copies bigint, block int, large boolean, shingles binary")

    def verify(table):
        groups: dict[str, list] = {}
        large, (_, *blocks) = table["large"][0].as_py(), table["unit"][0].as_py().split(":")
        for r in table.to_pylist():
            groups.setdefault(r["comp"], []).append((r["cls"], r["copies"], r["block"], np.frombuffer(r["shingles"], U64)))
        found = [x for g in groups.values() for x in _verified(g, similarity, len(set(blocks)) > 1)]
        return pa.table({"cls": [x[0] for x in found], "links": pa.array([x[1] for x in found], pa.int64()), "root": [x[2] for x in found], "large": [large] * len(found)})

    return durable(dealt.groupBy("unit").applyInArrow(verify, "cls string, links bigint, root string, large boolean"), "links")


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links for each document; class_id is the document's own id where nothing is linked."""
    j = join(docs, **options)
    own = F.when(~F.col("anon"), F.col("key"))
    return j.select(own.alias("doc_id"), F.when(F.col("cls").isNull(), own).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, that of the least id. All columns pass through, under any names."""
    anon, key, cls = "_similar_anon", "_similar_key", "_similar_cls"
    while {anon, key, cls} & {c.lower() for c in docs.columns}:
        anon, key, cls = (f"{c}_" for c in (anon, key, cls))
    j = join(docs, **options)
    kept = durable(j.filter("cls is null or (anon = first.anon and key = first.key)").select("anon", "key", "cls").distinct(), "kept")
    repeated = not j.groupBy("anon", "key").count().filter("count > 1").isEmpty()
    mine = docs.withColumn(anon, F.col("doc_id").isNull()).withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))))
    on = kept.select(F.col("anon").alias(anon), F.col("key").alias(key), F.col("cls").alias(cls))
    if not repeated:
        return mine.join(on, [anon, key], "left_semi").drop(anon, key)
    # several rows under one id: those of a kept class stay, one of each class and id
    digested = F.pandas_udf(_digests(options.get("words", WORDS)), "string")
    mine = mine.withColumn(cls, digested(F.col("text").cast("string")))
    wordless = mine.filter(F.col(cls).isNull()).drop(anon, key, cls)
    rest = mine.join(on.filter(F.col(cls).isNotNull()), [anon, key, cls], "left_semi")
    return rest.dropDuplicates([anon, key, cls]).drop(anon, key, cls).unionByName(wordless)


def _digests(words: int):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(s) for s in shingle_sets([(t or "").encode() for t in texts], words)])

    return run
