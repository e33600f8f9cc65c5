"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. A temperature fitted on rows left out of
the descent calibrates the scores, and the lowest score at which kept rows reach TRUST accuracy is the threshold
below which a prediction counts as rejected. Every language that a row not held out names is learned, however many
there are and however rare: with many, the larger ones give fewer rows each; rows of the small ones are repeated.

A null text, or one without a letter, is `und` with score 0 and rejected; so is every row if there is nothing to
learn from. A null id is held out. Repeated rows are predicted each for itself. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded, every_class, remainder
from .segments import slices, trim
from .store import by_bytes

#: Rows learned from per language, and of all languages together (one row a language at least).
PER_LANGUAGE, ROWS = 400, 25600
BUCKET_BITS, DIMS, SIZES, EPOCHS, BATCH, RATE = 15, 8, (2, 3, 4), 6, 32, 4.0
#: Accuracy that accepted predictions shall have.
TRUST = 0.99
#: Bytes of text, and scores of a text in a language, that are computed at once.
AT_ONCE, SCORES = 1 << 20, 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_CLEAN = np.arange(256, dtype=np.uint64)
_CLEAN[65:91] += 32
_CLEAN[:65] = _CLEAN[91:97] = _CLEAN[123:128] = 32


def subwords(blob: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram of each size that starts at each byte (A-Z lower-cased, non-letters as spaces)."""
    x = np.concatenate([_CLEAN[blob], np.full(max(SIZES), 32, np.uint64)])
    out, h = [], x
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] << np.uint64(8)) | x[n - 1 :]
        if n in SIZES:
            out.append(((h[: len(blob)] + np.uint64(n << 40)) * _MUL >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times softmax weights; (buckets, DIMS) embeddings if languages are more
    weights: np.ndarray | None  # (DIMS, languages) if the table holds embeddings
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        blob = np.frombuffer(b"  ".join([*texts, b""]), np.uint8)
        lens = np.array([len(t) + 2 for t in texts])
        starts = np.cumsum(lens) - lens
        grams = subwords(blob)
        total = np.zeros((len(texts), self.table.shape[1]))
        for c in range(self.table.shape[1]):
            col = np.ascontiguousarray(self.table[:, c])
            each = col[grams[0]]
            for g in grams[1:]:
                each += col[g]
            total[:, c] = np.add.reduceat(each, starts, dtype=np.float64)
        mean = total / (lens * len(grams))[:, None]
        return (mean if self.weights is None else mean @ self.weights) + self.bias

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> Model | None:
    if not texts:
        return None
    langs = sorted(set(labels))
    number = {x: k for k, x in enumerate(langs)}
    y = np.array([number[x] for x in labels])
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        g, n = np.unique(np.concatenate(subwords(np.frombuffer(t + b"  ", np.uint8))), return_counts=True)
        bags.append((g, (n / n.sum()).astype(np.float32)))
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMS)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIMS, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    order = rng.permutation(len(texts))
    aside = order[: len(order) // 5]
    train = order[len(aside) :]
    unseen = ~np.isin(y[aside], y[train])
    train, aside = np.concatenate([train, aside[unseen]]), aside[~unseen]
    own = np.bincount(y[train], minlength=len(langs))
    times = np.maximum(1, min(own.max(), ROWS // len(langs)) // own)  # a small language's rows come as often as a large one's
    if times.max() > 1:
        train = rng.permutation(np.repeat(train, times[y[train]]))

    def hidden(some):
        idx = np.concatenate([bags[i][0] for i in some])
        wt = np.concatenate([bags[i][1] for i in some])
        size = np.array([len(bags[i][0]) for i in some])
        return idx, wt, size, np.add.reduceat(emb[idx] * wt[:, None], np.cumsum(size) - size)

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(train), BATCH):
            some = rng.permutation(train)[:BATCH] if k == 0 else train[k : k + BATCH]
            idx, wt, size, h = hidden(some)
            d = _softmax(h @ w + b)
            d[np.arange(len(some)), y[some]] -= 1
            d /= len(some)
            dh = d @ w.T
            w -= rate * h.T @ d
            b -= rate * 0.1 * d.sum(0)
            step = np.repeat(dh, size, axis=0) * wt[:, None] * (rate * 50)
            for c in range(DIMS):
                emb[:, c] -= np.bincount(idx, step[:, c], len(emb))
        train = rng.permutation(train)
    model = Model(langs, emb @ w, None, b, 1.0, 0.0) if len(langs) <= DIMS else Model(langs, emb, w, b, 1.0, 0.0)
    if len(aside):
        z = np.concatenate([hidden(aside[k : k + 256])[3] @ w + b for k in range(0, len(aside), 256)])
        truth = y[aside]
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = _softmax(z / model.temperature)
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum((p.argmax(1) == truth)[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= TRUST)
        model.threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = ROWS) -> Model | None:
    """Fits the model to a sample of the labelled rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").filter((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    got = bounded(every_class(rows, "lang", "doc_id", per_language, total), "doc_id", "text", 2 * total).orderBy("doc_id", "text", "lang").collect()
    return fit([r.text.encode() for r in got], [r.lang for r in got])


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and accepted: whether the score reaches the calibrated threshold."""
    rows = by_bytes(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), F.when(F.col("text").rlike("\\p{L}"), F.col("text").cast("binary")).alias("text"))

    def run(batches):
        for b in batches:
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for a, z in slices(b.column(2), AT_ONCE) if model else ():
                texts = b.column(2).slice(a, z - a).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None]
                most = max(1, SCORES // len(model.langs))
                for part in (some[k : k + most] for k in range(0, len(some), most)):
                    best, p = model.scores([texts[i] for i in part])
                    for i, k, s in zip(part, best.tolist(), p.tolist(), strict=True):
                        lang[a + i], score[a + i] = model.langs[k], s
            trim()
            ok = [x != "und" and s >= model.threshold for x, s in zip(lang, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(ok, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
