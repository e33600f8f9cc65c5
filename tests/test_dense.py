"""Dense search by blocks against every pair's inner product."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.catalogue import QUERIES
from ledgerlight.operators import dense, retrieval, sparse

SF = "/root/testdata/sf0.001"


def _every_pair(vectors, queries, k):
    by = F.aggregate(F.zip_with("v", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    s = vectors.crossJoin(F.broadcast(queries)).select("query_id", "id", F.round(by, 6).alias("score"))
    return retrieval.top(s, k)


@pytest.mark.parametrize("tile", [dense.TILE, 64])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors_and_ties(spark, monkeypatch, kind, tile):
    rng = np.random.default_rng(5)
    rows = [[float(x) for x in rng.integers(-4, 5, 3) / 1000] for _ in range(300)] + [[0.001, 0.001, 0.001]] * 40  # many equal scores
    rows += [None, [], [1.0], [1.0, None, 1.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0], [float("inf"), float("-inf"), 1.0], [1e30, 1e30, 1e-30], [0.0, 0.0, 0.0], [0.0007071, 0.0, 0.0]]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id long, v array<{kind}>").repartition(5)
    q = v.filter("id % 7 = 0 or id > 338").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    monkeypatch.setattr(dense, "PASS_BEST", 200)  # several passes
    monkeypatch.setattr(dense, "TILE", tile)
    for k in (1, 7):
        got, want = ([tuple(map(str, r)) for r in t.select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()] for t in (retrieval.dense_top(v, q, k), _every_pair(v, q, k)))
        assert got == want and len(got) > 50


def test_names_as_ids(spark):
    v = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), (None, [1.0]), ("ab", [0.5])], "id string, v array<double>")
    q = spark.createDataFrame([("x", [1.0]), (None, [1.0])], "query_id string, q array<double>")
    got = retrieval.dense_top(v, q, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(n, i) for n in (None, "x") for i in (None, "a", "b")]


@pytest.mark.parametrize("name", ["q22_dense_topk", "q24_dense_filter_after", "q27_minmax", "q30_cache_probe"])
def test_pairs_are_no_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_rounding_is_that_of_decimals():
    x = np.array([0.1234565, 0.1234575, 0.9999995, 1e-7, 5e-7, 123456.1234565, 7e12, np.inf])
    assert dense.rounded(x).tolist() == [0.123457, 0.123458, 1.0, 0.0, 1e-6, 123456.123457, 7e12, np.inf]


@pytest.mark.parametrize(("group", "block"), [(sparse.GROUP, sparse.BLOCK), (1, 1), (40, 64)])
def test_best_of_bm25_are_those_of_all_scores(spark, monkeypatch, group, block):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(200)] + [(i, "alpha beta beta") for i in range(200, 260)] + [(260, None), (261, ""), (262, "other words"), (263, "ALPHA alpha ALPHA")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([("a", "alpha alpha beta"), ("b", "gamma nowhere"), ("c", ""), ("d", None), (None, "theta eta alpha"), ("e", "nowhere")], "item_id string, text string")
    monkeypatch.setattr(sparse, "GROUP", group)
    monkeypatch.setattr(sparse, "BLOCK", block)
    index = retrieval.Bm25(docs)
    shown = lambda t: [tuple(r) for r in t.select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()]
    want = shown(retrieval.top(index.scores(asked, "item_id", "text"), 7))
    assert shown(index.best(asked, "item_id", "text", 7)) == want and len(want) == 21
    monkeypatch.setattr(retrieval, "SMALL_ROWS", 3)  # more terms than are sent
    assert shown(index.best(asked, "item_id", "text", 7)) == want
    monkeypatch.undo()
    assert shown(index.best(asked.filter("item_id = 'c'"), "item_id", "text", 7)) == []


@pytest.mark.parametrize("name", ["q21_bm25_topk", "q25_rrf", "q39_retrieval_confidence"])
def test_texts_are_not_split_before_they_are_dealt_nor_scores_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "regexp_extract_all" not in plan[plan.rindex("Repartition") :]


@pytest.mark.parametrize(("tile", "group", "block"), [(1 << 20, 4 << 20, 2 << 20), (50, 1, 1), (7, 40, 64)])
def test_blocks_of_any_size_give_the_same(monkeypatch, tile, group, block):
    """What a task does, in this process, where sizes can be set."""
    for module, name, value in ((dense, "TILE", tile), (dense, "ODD", 2), (sparse, "GROUP", group), (sparse, "BLOCK", block)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (90, 2)) / 8
    m[[4, 50]] = [[np.nan, 1], [np.inf, 1]]
    batch = pa.RecordBatch.from_pydict({"id": list(range(90)), "v": m.tolist(), "mark": [True] * 90})
    got = [r for b in dense._searched(SimpleNamespace(value=dense.groups(batch["id"], batch["v"])), 4)([batch.slice(0, 31), batch.slice(31)]) for r in b.to_pylist()]
    with np.errstate(all="ignore"):
        s = m[:, :1] * m[:, 0] + m[:, 1:] * m[:, 1]
    key = lambda q: lambda i: (not np.isnan(s[q, i]), -dense.rounded(s[q, [i]])[0], i)
    want = [(q, i) for q in range(90) for i in sorted((i for i in range(90) if np.isnan(s[q, i]) or s[q, i] > 0), key=key(q))[:4]]
    assert [(r["query_id"], r["id"]) for r in got] == want

    words = [None if i == 5 else [str(w) for w in rng.integers(0, 9, i % 7)] for i in range(80)]
    docs = pa.RecordBatch.from_pydict({"id": list(range(80)), "w": pa.array(words, pa.list_(pa.string())), "dl": [None if w is None else len(w) for w in words]})
    terms, query, term = pa.array([str(x) for x in range(8)]), np.repeat(np.arange(6), 3), rng.permuted(np.tile(np.arange(8), (6, 1)), axis=1)[:, :3].ravel()
    weight = rng.random(18) + 0.1
    sent = SimpleNamespace(value=(pa.array(list("abcdef")), terms, 3.0, query, term, weight))
    got = [r for b in sparse.scored(sent, 5, 1.5, 0.75)([docs.slice(0, 33), docs.slice(33)]) for r in b.to_pylist()]
    score = lambda q, i: sum(w * (c := words[i].count(str(t))) / (c + 1.5 * (0.25 + 0.75 * len(words[i]) / 3.0)) for t, w in zip(term[query == q], weight[query == q]))
    every = [{i: round(score(q, i), 6) for i in range(80) if words[i] and score(q, i) > 0} for q in range(6)]
    assert {(r["query_id"], r["id"]) for r in got} == {("abcdef"[q], i) for q in range(6) for i in sorted(every[q], key=lambda i: (-every[q][i], i))[:5]}
