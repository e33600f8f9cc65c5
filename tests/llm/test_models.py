"""Trained operators by held-out accuracy; mixing and neighbours against brute force; the pipeline's contract."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlight.llm import langid, mixing, neighbours, quality, sampling

LETTERS = {"en": "the and of with house shall river", "de": "der und nicht straße größe wird", "fr": "le les où été dans avec être"}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(LETTERS))
        rows.append((i, " ".join(rng.choice(LETTERS[lang].split()) for _ in range(rng.randrange(4, 40))), None if i % 10 == 0 else lang, 1.0))
    rows += [(900, None, "en", 1.0), (901, "123 !!", "de", 1.0), (902, "", None, 1.0), (None, "the house and the river", "en", 1.0), (5, rows[5][1], rows[5][2], 1.0), (903, "le les dans " * 40000, "fr", 1.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_language(tongues, empty):
    rows, frame = tongues
    got = langid.identify(frame).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.accepted) == ("und", False)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900 and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(frame.filter("lang is null")).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:02}" for k in range(70)]
    lexicon = {n: ["".join(rng.choices(alphabet, k=rng.randrange(4, 9))) for _ in range(8)] for n in names}
    free = [i for i in range(20000) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(20000) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = []
    for k, n in enumerate(names):
        say = lambda: " ".join(rng.choices(lexicon[n], k=20))  # noqa: B023, E731
        rows += [(free.pop(), say(), n) for _ in range(60 if k < 66 else 20)]
        rows += [(held.pop(), say(), n) for _ in range(4)]
    rows.append((free.pop(), "zzyzx qqqq xyxyx " * 9, "once"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learn(frame).langs) == {*names, "once"}
    truth = {r[0]: r[2] for r in rows}
    got = [r for r in langid.identify(frame).collect() if r.held_out]
    assert {r.lang_pred for r in got} >= set(names)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.95
    few = langid.every_class(frame, "lang", "doc_id", 400, 355).groupBy("lang").count().collect()  # five rows each
    assert len(few) == 71 and sum(r["count"] for r in few) < 500
    least = langid.every_class(frame, "lang", "doc_id", 400, 10).groupBy("lang").count().collect()
    assert len(least) == 71


def test_fair_share():
    for counts, each, total in (([5], 400, 10), ([5, 5, 90], 400, 40), ([1000] * 64, 400, 25600), ([1000] * 65, 400, 25600), ([1, 1, 1], 400, 2), ([3, 9, 9], 4, 100)):
        k = sampling.fair_share(counts, each, total)
        assert 1 <= k <= each
        assert k == 1 or sum(min(c, k) for c in counts) <= total
        assert k == each or sum(min(c, k + 1) for c in counts) > total


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        good = rng.random() < 0.8
        w = [rng.choice("house river mountain shall nature water garden".split()) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(20, 200))]
        text = " ".join(w) if good else " ".join(x.upper() + "$$$" for x in w)
        rows.append((i, text, "k"))
        if i % 4:
            marks.append((i, int(good), 0))
    rows += [(900, None, "k"), (901, "", "k"), (None, "house river", "k"), (902, "garden water " * 50000, "k")]
    marks += [(3, None, 0), (7, 1, 0), (7, 0, 0), (999, 1, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i: "$$$" not in t for i, t, _ in rows if t}


def test_quality(graded, empty):
    rows, docs, labels, truth = graded
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    kept = quality.keep_good(docs, quality.learn(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


# ---- mixing


def goals(sizes):
    """The targets by resharing the excess until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while len(done) < len(order):
        live = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        above = [s for s in live if share[s] > 3 * sizes[s]]
        if not above:
            return done | share
        done |= {s: 3.0 * sizes[s] for s in above}
    return done


def test_mixing(docs, rows, empty):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = goals(sizes)
    got = mixing.taken(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source, r.source_size) for r in got) == Counter((r[0], size(r[1]), r[3], sizes[r[3]]) for r in rows)
    by = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source] += r.taken
    assert all(abs(by[s] - want[s]) <= 1 for s in want), (dict(by), want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs).collect()), key=str)
    assert mixing.taken(empty).count() == 0


def test_shards_partition_the_draws(docs):
    one = mixing.draws(docs, depth=2).collect()
    words = Counter()
    for r in mixing.taken(docs).collect():
        words[r.doc_id] += r.taken
    drawn = Counter()
    for r in one:
        drawn[r.doc_id] += r.words
    assert drawn == +words and {r.shard for r in one} <= {0, 1, 2, 3}
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_words", "mix_shards"]


def test_quotas_halve_the_urn(spark):
    blocks = spark.createDataFrame([(s, b, b + 1, 1, 0, 1) for s in ("a", "b", None) for b in range(17)], "source string, block long, turn long, whole long, part long, draws int")
    q = mixing.quotas(blocks, 3).collect()
    by_shard, by_source = Counter(), Counter()
    for r in q:
        by_shard[r.shard] += r.hi - r.lo
        by_source[r.source] += r.hi - r.lo
    assert by_source == {"a": 17, "b": 17, None: 17} and max(by_shard.values()) - min(by_shard.values()) <= 1


# ---- neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (5004, [1.0] * 3, 1), (None, [1.0] * 16, 1), (5005, [float("inf")] * 16, 1), (7, x[7].tolist(), 1), (5050, [], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def nearest_brute(rows, k=5):
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    x /= np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for i in ids[ids % 50 == 0]:
        s = np.round(x @ x[np.searchsorted(ids, i)], 12)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours(vectors, spark):
    rows, frame = vectors
    want = nearest_brute(rows)
    got = defaultdict(list)
    for r in neighbours.nearest(frame, frame.filter("vec_id % 50 = 0"), leaf_rows=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]
    assert np.mean(hit) >= 0.9
    same = dict((v, s) for q in want for v, s in want[q])
    assert same and all(abs(s - next(b for a, b in want[q] if a == v)) < 1e-9 for q in want for v, s in got[q] if v in {a for a, _ in want[q]})
    assert [v for v, _ in got[150]] == [100, 101, 102, 103, 104]  # ties to the smaller id
    small = frame.filter("vec_id in (0, 1, 2)")
    assert [r["rank"] for r in neighbours.nearest(small, small.filter("vec_id = 0")).collect()] == [1, 2]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_neighbours_with_production_parameters(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    want = {int(q): {int(j) for j in ids[np.lexsort((ids, -np.where(ids == q, -2, np.round(x @ x[i], 12))))[:5]]} for i, q in enumerate(ids) if q % 50 == 0}
    got = defaultdict(set)
    for r in neighbours.nearest(frame, frame.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.97


def test_neighbours_of_any_size_and_length(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [2e-200, 1e-200]), (50, [1e200, 0.0]), (51, [1e200, 1e200]), (52, [-3.0, 1e-300]), (100, [1.0, 2.0, 3.0]), (101, [3.0, 2.0, 1.0]), (150, [5.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [5e-324, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(frame, frame.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got[0] == [(2, 1.0), (2, 1.0), (51, 1.0), (1, round(3 / np.sqrt(10), 9)), (3, round(1 / np.sqrt(2), 9))]  # a repeated row counts twice
    assert got[50][:2] == [(3, 1.0), (1, round(2 / np.sqrt(5), 9))] and (52, -1.0) not in got[50]
    assert got[100] == [(101, round(10 / 14, 9))] and 150 not in got


def test_neighbours_in_bounded_batches_and_cells(spark, monkeypatch):
    """Many queries in one batch and in one leaf: what Python hands on at once, and both sides of a cell, stay bounded."""
    x = np.random.default_rng(8).normal(size=(6000, 64)).astype(np.float32)
    x[1000:3000] = x[1000]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    asks = frame.filter("vec_id % 2 = 0")
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 512)
    frames, cells = type(frame), type(frame.groupBy("vec_id").cogroup(frame.groupBy("vec_id")))
    hand_on, meet = frames.mapInArrow, cells.applyInArrow

    def watched(batches):
        for b in batches:
            assert b.nbytes <= 8 << 20, b.nbytes
            yield b

    def few(left, right):
        assert max(left.num_rows, right.num_rows) <= 1024, (left.num_rows, right.num_rows)

    monkeypatch.setattr(frames, "mapInArrow", lambda self, fn, schema: hand_on(self, lambda b: watched(fn(b)), schema))
    monkeypatch.setattr(cells, "applyInArrow", lambda self, fn, schema: meet(self, lambda a, b: few(a, b) or fn(a, b), schema))
    got = sorted(map(tuple, neighbours.nearest(frame, asks).collect()))
    monkeypatch.setattr(neighbours, "AT_ONCE_BYTES", 0)
    assert got == sorted(map(tuple, neighbours.nearest(frame, asks).collect()))  # tree by tree
    assert len(got) == 5 * 3000 and [v for q, _, v, _ in got if q == 1002] == [1000, 1001, 1003, 1004, 1005]
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = np.round(unit[::50] @ unit.T, 12)
    near[np.arange(120), np.arange(0, 6000, 50)] = -2
    want = {50 * i: set(np.lexsort((np.arange(6000), -near[i]))[:5].tolist()) for i in range(120)}
    found = defaultdict(set)
    for q, _, v, _ in got:
        found[q].add(v)
    assert np.mean([len(found[q] & want[q]) / 5 for q in want]) >= 0.9


# ---- pipeline


ODD = ("mix_words", "mix_shards", "_mix_id", "_leak_row", "_similar_key", "_similar_cls", "_redacted")


def test_stages_on_odd_rows(spark, docs, rows):
    """Each stage against what its operator says of every row, with nulls, repeated rows and clashing names."""
    from ledgerlight.llm import decontaminate, pii, similar

    frame = docs.select("*", *[docs["key"].alias(c) for c in ODD])
    texts = [(r[0], r[1]) for r in rows]
    model = quality.fit([b"aa bb cc"] * 9 + [b"$$$ %%% &&&"] * 9, [1] * 9 + [0] * 9, 0.5)
    import pyarrow as pa

    kept = Counter(x for x, s in zip(texts, quality.scores_of(pa.array([(t or "").encode() for _, t in texts]), model)) if s >= quality.THRESHOLD)
    good = quality.keep_good(frame, model)
    assert good.columns == frame.columns and Counter((r.doc_id, r.text) for r in good.collect()) == kept
    private = pii.redact(frame)
    finder = pii.model()
    assert private.columns == frame.columns and Counter((r.doc_id, r.text) for r in private.collect()) == Counter((i, None if t is None else pii.redacted(t, finder.spans(t)[1])) for i, t in texts)
    one = similar.keep_one(frame)
    assert one.columns == frame.columns and 0 < one.count() < len(rows)
    assert decontaminate.keep_clean(frame, spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")).columns == frame.columns
    mixed = mixing.mix(frame)
    assert mixed.columns == [*frame.columns, "mix_words_", "mix_shards_"]
    words = Counter()
    for r in mixing.taken(frame).collect():
        words[r.doc_id, r["size"]] += r.taken
    got = Counter()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in {(r.doc_id, r.text): r for r in mixed.collect()}.values():
        got[r.doc_id, size(r.text)] += r["mix_words_"]
    assert got == +words


def test_the_tree_decides_the_shards(docs, monkeypatch):
    shards = lambda: Counter((r.doc_id, r.shards) for r in mixing.taken(docs).collect())
    one = shards()
    assert one == shards()
    monkeypatch.setattr(mixing, "_drawn", lambda balls, n, rest, unit: (mixing.F.least(balls, n)).cast("bigint"))  # another tree
    assert shards() != one


def test_hypergeometric_numbers(spark):
    from pyspark.sql import functions as F

    units = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    drawn = [r[0] for r in units.select(mixing._drawn(F.lit(30), F.lit(40), F.lit(100), F.col("u"))).collect()]
    assert abs(np.mean(drawn) - 12) < 0.05 and abs(np.var(drawn) - 40 * 0.3 * 0.7 * 60 / 99) < 0.1
    edge = units.limit(3).select(mixing._drawn(F.lit(5), F.lit(9), F.lit(9), F.col("u")), mixing._drawn(F.lit(0), F.lit(4), F.lit(9), F.col("u")), mixing._drawn(F.lit(0), F.lit(0), F.lit(0), F.col("u"))).collect()
    assert {tuple(r) for r in edge} == {(5, 0, 0)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "similar", "clean", "private", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, base).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        if name != "mix":
            assert docs.columns == before.columns and docs.count() <= before.count()
    assert "mix_words" in docs.columns and docs.count() > 0


def test_pipeline_leaves_its_result_alone(spark):
    import glob

    import corpus_pipeline

    from ledgerlight.llm import store

    base = store.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(glob.glob(f"{base}/*")) - before
    assert out.count() > 0 and len(left) == 1 and "stage-mix" in left.pop()


def test_pipeline_on_nothing(spark, empty, tmp_path):
    import corpus_pipeline

    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(out)
        docs = spark.read.parquet(out)
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_suffix_dedup", "op7_similar", "op8_mix"])
def test_queries_against_sql(spark, name):
    import duckdb

    from ledgerlight.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    tidy = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert tidy(got) == tidy(want)
