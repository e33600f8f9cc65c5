"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE tokens. Every passage is encoded from hashed token embeddings and from
shares of kinds of characters and of repeated words; a gated attention, learned from document labels alone, weighs
the passages, and the weighted representation is scored. Embeddings, encoder, attention and score are trained
together by Adam in numpy on a bounded sample of labelled rows; a Platt scale fitted on sampled rows left out of the
training, with the sample's class shares put back to the table's, makes the score the probability of label 1.

A null or empty text is a bag of one empty passage. Labels that are null or contradict each other are not used; a
null id is held out. With no labels of both kinds every score is 1. Repeated rows are scored each for itself.
Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded, per_class, remainder
from .segments import slices, trim
from .store import by_bytes
from .tokens import SOLID, U64, Words, mix

PASSAGE = 64
#: Labelled rows learned from, per class.
PER_CLASS = 1200
#: A score from here on predicts label 1.
THRESHOLD = 0.3
TOKEN_BITS, TOKEN_DIMS, HIDDEN, ATTEND, EPOCHS, BATCH, RATE = 12, 4, 12, 6, 12, 16, 0.01
#: Bytes of text that are scored at once.
AT_ONCE = 1 << 20


def _kinds() -> np.ndarray:
    """(kind, byte): upper case, lower case, digits, sentence marks, other ASCII marks, bytes from 128 on, spaces, line feeds."""
    k = np.zeros((8, 256), bool)
    k[0, 65:91] = k[1, 97:123] = k[2, 48:58] = k[5, 128:] = k[6, 32] = k[7, 10] = True
    k[3, list(b".,;:?'\"-()")] = True
    k[4, 33:127] = ~k[:4, 33:127].any(0)
    return k


KINDS = _kinds()
STATS = len(KINDS) + 5


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of each text; statistics of each passage; token buckets; tokens of each passage."""
    lens = np.array([len(t) for t in texts], np.int64)
    blob = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    w = Words(blob, lens, SOLID)
    n = np.maximum(1, -(-w.counts // PASSAGE))
    first_word = np.cumsum(w.counts) - w.counts
    doc = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    word = first_word[doc] + nth * PASSAGE
    size = np.clip(w.counts[doc] - nth * PASSAGE, 0, PASSAGE)
    start = np.cumsum(lens + 1) - lens - 1
    begin = np.where(nth == 0, start[doc], w.starts[np.minimum(word, max(len(w.starts) - 1, 0))] if len(w.starts) else start[doc])
    span = np.maximum(np.diff(begin, append=len(blob)), 1).astype(np.float64)
    stats = np.zeros((len(doc), STATS), np.float32)
    for k, kind in enumerate(KINDS):
        stats[:, k] = np.add.reduceat(kind[blob], begin, dtype=np.int64) / span
    passage = np.repeat(np.arange(len(doc)), size)
    some = np.maximum(size, 1)
    length = (w.ends - w.starts).astype(np.float64)
    stats[:, -5] = np.bincount(passage, length, len(doc)) / some / 10
    last = blob[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    stats[:, -4] = np.bincount(passage, KINDS[4][last], len(doc)) / some
    for at, key in ((-3, w.hash ^ mix(passage.astype(U64))), (-2, mix(w.hash ^ np.roll(w.hash * U64(3), 1)) ^ mix(w.doc.astype(U64)))):
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(order), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        stats[:, at] = np.bincount(passage, again, len(doc)) / some
    stats[:, -1] = np.log1p(w.counts[doc]) / 10
    return n, stats, (w.hash >> U64(64 - TOKEN_BITS)).astype(np.int64), size


@dataclass
class Model:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def encode(self, stats, tokens, size):
        p = self.p
        full = size > 0
        emb = np.zeros((len(size), TOKEN_DIMS), np.float32)
        if full.any():
            emb[full] = np.add.reduceat(p["emb"][tokens], (np.cumsum(size) - size)[full]) / size[full, None]
        x = np.concatenate([(stats - p["mean"]) / p["sd"], emb], 1)
        return x, np.tanh(x @ p["a"] + p["b"])

    def forward(self, n, stats, tokens, size):
        p = self.p
        x, h = self.encode(stats, tokens, size)
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["w"]
        at = np.cumsum(n) - n
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        alpha = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(alpha[:, None] * h, at)
        return x, h, t, g, alpha, z, z @ p["s"] + p["c"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit = self.forward(*bags(texts))[-1].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -50, 50)))


def _gradients(m: Model, n, stats, tokens, size, y, weight) -> dict[str, np.ndarray]:
    p = m.p
    x, h, t, g, alpha, z, logit = m.forward(n, stats, tokens, size)
    d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
    at, bag = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    dz = d[:, None] * p["s"]
    dalpha = (dz[bag] * h).sum(1)
    de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, at)[bag])
    dtg = de[:, None] * p["w"]
    dv, du = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = alpha[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T
    da = dh * (1 - h * h)
    dx = (da @ p["a"].T)[:, STATS:] / np.maximum(size, 1)[:, None]
    step = np.repeat(dx, size, axis=0)
    emb = np.stack([np.bincount(tokens, step[:, k], 1 << TOKEN_BITS) for k in range(TOKEN_DIMS)], 1).astype(np.float32)
    return {"s": z.T @ d, "c": d.sum(keepdims=True), "w": (t * g).T @ de, "v": h.T @ dv, "u": h.T @ du, "a": x.T @ da, "b": da.sum(0), "emb": emb}


def fit(texts: list[bytes], labels: list[int], share: float, seed: int = 11) -> Model | None:
    """share: the share of label 1 among the rows that the sample stands for."""
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside, train = order[: len(order) // 5], order[len(order) // 5 :]
    cached = [bags([t]) for t in texts]
    join = lambda some: [np.concatenate([cached[i][k] for i in some]) for k in range(4)]
    every = join(train)[1]
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    wide = STATS + TOKEN_DIMS
    p = {"mean": every.mean(0), "sd": every.std(0) + 1e-3, "emb": draw(1 << TOKEN_BITS, TOKEN_DIMS), "a": draw(wide, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, ATTEND), "u": draw(HIDDEN, ATTEND), "w": draw(ATTEND), "s": draw(HIDDEN), "c": np.zeros(1, np.float32)}
    m = Model(p)
    moment = {k: [np.zeros_like(p[k]), np.zeros_like(p[k])] for k in p if k not in ("mean", "sd")}
    ones = max(y[train].mean(), 1e-3)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / max(1 - ones, 1e-3))
    step = 0
    for _ in range(EPOCHS):
        train = rng.permutation(train)
        for k in range(0, len(train), BATCH):
            some = train[k : k + BATCH]
            step += 1
            for name, g in _gradients(m, *join(some), y[some], weight[some]).items():
                a, b = moment[name]
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p[name] -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    side = aside if len(aside) and 0 < y[aside].sum() < len(aside) else order
    z, t = np.concatenate([m.forward(*join(side[k : k + 64]))[-1] for k in range(0, len(side), 64)]).astype(np.float64), y[side]
    back = np.where(t == 1, share / max(t.mean(), 1e-3), (1 - share) / max(1 - t.mean(), 1e-3))
    u = np.zeros(2)
    for _ in range(50):  # Newton steps of the weighted, slightly ridged Platt scale
        q = 1 / (1 + np.exp(-np.clip(u[0] * z + u[1], -50, 50)))
        x = np.stack([z, np.ones_like(z)], 1)
        grad = x.T @ (back * (q - t)) + 0.1 * u
        hess = (x * (back * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
        u -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    m.slope, m.shift = max(float(u[0]), 0.0), float(u[1])
    return m


def learn(docs: DataFrame, labels: DataFrame, each: int = PER_CLASS) -> Model | None:
    """Fits the model to a sample of each class among the labelled rows that are not held out."""
    marks = labels.filter((remainder("doc_id", 5) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    marks = marks.filter("lo = hi").select(F.col("doc_id").cast("bigint").alias("mark_id"), F.col("lo").cast("int").alias("mark"))
    shares = {r.mark: r["count"] for r in marks.groupBy("mark").count().collect()}
    if len(shares) < 2:
        return None
    chosen = F.broadcast(per_class(marks, "mark", "mark_id", each, 2))  # at most about 2 * each rows
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(chosen, F.col("doc_id") == F.col("mark_id"))
    got = bounded(got, "doc_id", "text", 4 * each).collect()
    got = sorted({(r.doc_id, r.mark, bytes(r.text or b"")) for r in got})
    return fit([t for _, _, t in got], [y for _, y, _ in got], shares[1] / (shares[0] + shares[1]))


def scores_of(texts: pa.Array, model: Model | None) -> np.ndarray:
    """The score of each text (binary or null); bounded bytes at once."""
    out = np.ones(len(texts))
    if model is not None:
        for a, z in slices(texts, AT_ONCE):
            out[a:z] = model.scores([t or b"" for t in texts.slice(a, z - a).to_pylist()])
        trim()
    return out


SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    rows = by_bytes(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            s = scores_of(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that the model rejects. No column but text leaves the JVM; all pass through."""

    def good(texts: pa.Array) -> pa.Array:
        return pa.array(scores_of(texts, model) >= THRESHOLD)

    return by_bytes(docs).filter(F.arrow_udf(good, "boolean")(F.col("text").cast("binary")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
