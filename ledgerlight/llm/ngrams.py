"""Scoring texts with an n-gram language model in Elias-Fano tries.

The model is counted over all documents that are not held out. Texts are tokenised once; segments hold their tokens
instead of the texts. Words get ids from a first exchange, which also
brings their counts; each further level of the trie is cut into shards by a hash of (context, word), so that a
context with very many words spreads over all shards. A shard sums the counts of its entries, stores smoothed
probabilities in a memory-mapped trie level, and answers the segments that asked; the place of an entry in its level
is the id that the level below has as its children's parent. Smoothing is Dirichlet's: the probability of w after a
context h is

    count(h w) / (count(h) + strength)  +  strength / (count(h) + strength) * probability of w after the shorter context

with (count(w) + 1) / (N + V + 1) at the bottom, which leaves one share for unknown words. The first term is what
the trie holds, quantised; the second follows from counts that the asking segment has. Segments and shards are of
bounded size, so long texts and large corpora mean more of them.

Tokens are words without white space, A-Z lower-cased, and one end for each text. A null text counts as empty: one
token. A null id is held out. Without anything to learn from every probability is 1. Repeated rows are scored and
counted each for itself; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import dec, dec_sorted, enc, enc_sorted
from .eliasfano import Level
from .segments import Seg, Segments, by_bucket, split, trim
from .tokens import SOLID, U64, Words, distinct, mix, order_by, uniques

#: Words of an n-gram.
ORDER = 3
#: Weight of the shorter context's distribution, in counts.
STRENGTH = 500.0
END = mix(np.array([1], U64))[0]
_ODD = U64(0xC2B2AE3D27D4EB4F)


def held_out(ids: list) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def _tokenised(lens: list, blob: bytes) -> bytes:
    """The tokens of a segment's texts with their ends: the tokens of each text, the distinct ones, ascending, which of
    them are how frequent, and each token's place in that order, where small numbers are many."""
    w = Words(np.frombuffer(blob, np.uint8), np.array([x or 0 for x in lens], np.int64), SOLID)
    n = w.counts + 1
    total = int(n.sum())
    key = np.empty(total, U64)
    last = np.cumsum(n) - 1
    key[last] = END
    word = np.ones(total, bool)
    word[last] = False
    key[word] = w.hash
    del w, word
    keys, counts, place = uniques(key)
    del key
    by_count = order_by(counts.max() - counts)
    rank = np.empty(len(keys), np.uint32)
    rank[by_count] = np.arange(len(keys))
    parts = [enc(n), enc_sorted(keys), enc(by_count.astype(np.uint32)), enc(rank[place])]
    del keys, counts, place, by_count, rank, last, n
    trim()
    return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)


class _Tokens:
    """Tokens of a segment with their ends: doc, word (place among the segment's distinct words), first (of a text)."""

    def __init__(self, s: Seg):
        head = 8 * 4
        at = head + np.cumsum([0, *np.frombuffer(s.stored[:head], np.int64)])
        n, self._keys, by_count, rank = (s.stored[a:z] for a, z in zip(at[:-1], at[1:], strict=True))
        self.n = dec(n, np.int64)
        self.word = dec(by_count, np.uint32).astype(np.int64)[dec(rank, np.uint32)]
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.held = held_out(s.ids)
        self.train = np.repeat(~self.held, self.n)
        self.end = self.word[self.n[0] - 1]

    def keys(self) -> np.ndarray:
        """The distinct words, by place."""
        return dec_sorted(self._keys)


def _emit_words(s: Seg, buckets: int):
    t = _Tokens(s)
    keys = t.keys()
    counts = np.bincount(t.word[t.train], minlength=len(keys))
    at = split(keys, buckets)
    for b in range(buckets):
        x = slice(at[b], at[b + 1])
        if x.stop > x.start:
            yield {"bucket": b, "seg": s.seg, "keys": enc_sorted(keys[x]), "counts": enc(counts[x])}


def _gaps(places: np.ndarray) -> bytes:
    """The ascending places among some that may be -1."""
    return enc(np.diff(places[places >= 0], prepend=0))


def _placed(raw: bytes, there: np.ndarray, first: int, none: int) -> np.ndarray:
    """What _gaps() packed, from first on, where something is there; none elsewhere."""
    out = np.full(len(there), none)
    out[there] = np.cumsum(dec(raw, np.int64)) + first
    return out


def _count_words(rows: list[dict]):
    keys = [dec_sorted(r["keys"]) for r in rows]
    size = np.cumsum([0, *map(len, keys)])
    words, _, place = uniques(np.concatenate(keys))
    total = np.bincount(place, np.concatenate([dec(r["counts"], np.int64) for r in rows])).astype(np.int64)
    known = total > 0
    rank = np.where(known, np.cumsum(known) - 1, -1)
    for r, a, z in zip(rows, size[:-1], size[1:], strict=True):
        yield {"seg": r["seg"], "bucket": r["bucket"], "counts": enc(total[place[a:z]]), "ranks": _gaps(rank[place[a:z]]), "known": int(known.sum()), "tokens": int(total.sum())}


WORDS = "seg long, bucket int, counts binary, ranks binary, known long, tokens long"


#: The probability of each code.
_POWERS = 10 ** (-np.arange(Level.NONE + 1) * Level.STEP)
_POWERS[Level.NONE] = 0


class _Ids:
    """Ids of the entries of a level: those of one bucket after those of the one before, in the bucket's order."""

    def __init__(self, answers: DataFrame, start: int):
        sizes = answers.groupBy("bucket").agg(F.first("known").alias("known")).collect()
        self.offset, at = {}, start
        for r in sorted(sizes, key=lambda r: r.bucket):
            self.offset[r.bucket] = at
            at += r.known
        self.end = at


class _Vocabulary(_Ids):
    """Ids from 1 in the order of the words' hashes; 0 is every unknown word, and the beginning comes after the last."""

    def __init__(self, answers: DataFrame, strength: float):
        super().__init__(answers, 1)
        self.types, self.begin, self.strength = self.end - 1, self.end, strength
        self.tokens = sum(r.tokens for r in answers.groupBy("bucket").agg(F.first("tokens").alias("tokens")).collect())
        self.levels: dict[int, _Ids] = {}


class _Walk:
    """The tokens of a segment on their way down the trie.

    At each level a token has a context: the entry of the level above that ends in the token before it. Of contexts
    the segment knows the id and the count (as a context, in all training texts). Entries whose context or word no
    training text holds have count 0; the others are asked for, by the ids of context and word."""

    def __init__(self, s: Seg, answers: list[dict], v: _Vocabulary, scoring: bool):
        """scoring: whether probabilities are wanted, or only what leads to the next level."""
        t = self.t = _Tokens(s)
        self.v, self.scoring = v, scoring
        each = [dec(r["counts"], np.int64) for r in answers]
        counts = np.concatenate(each)
        ids = np.concatenate([_placed(r["ranks"], x > 0, v.offset[r["bucket"]], 0) for r, x in zip(answers, each, strict=True)])
        self.word_id = ids
        if scoring:
            bottom = (counts + 1.0) / (v.tokens + v.types + 1.0)
            self.p, self.base, self.known = bottom[t.word], np.log10(bottom)[t.word], (counts > 0)[t.word]
            self.depth = np.arange(len(t.word)) - np.repeat(t.first, t.n)
        # level 2: the context is the word before, or the beginning, which occurs once a text
        self.context = np.roll(t.word, 1)
        self.context[t.first] = len(counts)
        self.context_id = np.append(np.where(ids > 0, ids, -1), v.begin)
        self.total = np.append(counts, counts[t.end])

    def entries(self, buckets: int) -> None:
        """The distinct (context, word), by ids ascending; those that are asked for, shard by shard, with the ids of
        context and word, and the bounds of the shards."""
        self.c, self.w, self.place = distinct(self.context, self.t.word)
        context, word = self.context_id[self.c], self.word_id[self.w]
        ask = (context >= 0) & (word > 0)
        context, word = context[ask].astype(U64), word[ask].astype(np.uint32)
        shard = ((mix(context * _ODD + word) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")  # by radix where shards are few
        self.asked, self.asked_context, self.asked_word = np.flatnonzero(ask)[order], context[order], word[order]
        self.bounds = np.cumsum([0, *np.bincount(shard, minlength=buckets)])

    def settle(self, answers: list[dict], level: int, last: bool) -> None:
        """Takes what the shards answered for this level; unless it is the last, moves to the next one."""
        asked = self.asked
        if self.scoring:
            code = np.full(len(self.c), Level.NONE, np.uint16)
            if len(asked):
                code[asked] = np.concatenate([dec(r["codes"], np.uint16) for r in answers])
            rest = self.v.strength / (self.total + self.v.strength)
            longer = _POWERS[code[self.place]] + rest[self.context] * self.p
            self.p = np.where(self.depth >= level - 2, longer, self.p)  # near the beginning the shorter context is all there is
        if last:
            return
        # the context of a token is the entry of the token before it, numbered by id; the first of a text has none.
        # Shards and what they hold are in the order of ids, so the asked entries are, too
        count = ids = np.zeros(0, np.int64)
        if len(asked):
            each = [dec(r["counts"], np.int64) for r in answers]
            count = np.concatenate(each)
            ids = np.concatenate([_placed(r["ranks"], x > 0, self.v.levels[level].offset[r["bucket"]], -1) for r, x in zip(answers, each, strict=True)])
        there = ids >= 0
        found = asked[there]
        rank, none = np.ones(len(self.c), bool), len(self.c) - len(found)
        rank[found] = False
        rank = np.cumsum(rank) - 1
        rank[found] = np.arange(none, len(self.c))
        self.context = np.roll(rank[self.place], 1)
        self.context[self.t.first] = len(self.c)
        self.context_id = np.concatenate([np.full(none, -1), ids[there], [-1]])
        self.total = np.concatenate([np.zeros(none, np.int64), count[there], [0]])


def _descend(s: Seg, answers: list[dict], v: _Vocabulary, buckets: int, level: int, last: bool) -> _Walk:
    """The walk at a level: at its entries, or behind its answers if it is the last one."""
    by_level: dict[int, list[dict]] = {}
    for r in answers:
        by_level.setdefault(r["level"], []).append(r)
    x = _Walk(s, by_level[1], v, last)
    for k in range(2, level + 1):
        x.entries(buckets)
        if k < level or last:
            x.settle(by_level.get(k, []), k, last and k == level)
    return x


def _ask(s: Seg, answers: list[dict], v: _Vocabulary, buckets: int, level: int):
    x = _descend(s, answers, v, buckets, level, False)
    sums = np.bincount(x.place[x.t.train], minlength=len(x.c))[x.asked]
    context = x.c[x.asked]
    total = x.total[context]
    for b, (i, j) in enumerate(zip(x.bounds[:-1], x.bounds[1:], strict=True)):
        if i < j:
            new = np.append(True, context[i + 1 : j] != context[i : j - 1])
            yield {"bucket": b, "seg": s.seg, "contexts": enc_sorted(x.asked_context[i:j]), "words": enc(x.asked_word[i:j]), "counts": enc(sums[i:j]), "totals": enc(total[i:j][new])}


def _finish(s: Seg, answers: list[dict], v: _Vocabulary, buckets: int, order: int):
    x = _descend(s, answers, v, buckets, order, True)
    t, n = x.t, len(s.ids)
    sums = lambda a: np.bincount(t.doc, a, n)
    yield {"doc_id": s.ids, "held_out": t.held, "n_tokens": t.n, "n_known": sums(x.known).astype(np.int64), "train_tokens": np.full(n, v.tokens), "base_score": sums(x.base), "score": sums(np.log10(x.p))}


def _build(rows: list[dict], strength: float, last: bool):
    """Counts a shard's entries, stores them as a level of the trie, and looks up in it what each segment asked for."""
    c, w = [dec_sorted(r["contexts"]) for r in rows], [dec(r["words"], np.uint32) for r in rows]
    size = np.cumsum([0, *map(len, c)])
    context, word = np.concatenate(c), np.concatenate(w)
    count = np.concatenate([dec(r["counts"], np.int64) for r in rows])
    total = np.concatenate([dec(r["totals"], np.int64)[np.cumsum(np.append(True, x[1:] != x[:-1])) - 1] for r, x in zip(rows, c, strict=True)])
    order = order_by(context, word)
    a, b = context[order], word[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    at = np.flatnonzero(new)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    asked, words = a[at], b[at].astype(U64)
    sums = np.add.reduceat(count[order], at)
    at, sums = at[sums > 0], sums[sums > 0]
    level = Level.mapped(Level.pack(a[at], b[at], np.log10(sums / (total[order][at] + strength))))
    del count, total, order, a, b, context, word
    looked_up = level.find(asked, words)  # each entry once, in order
    for r, i, j in zip(rows, size[:-1], size[1:], strict=True):
        found = looked_up[place[i:j]]
        hit, safe = found >= 0, np.maximum(found, 0)
        pick = lambda x, none: np.where(hit, x[safe], none) if len(x) else np.full(len(hit), none, x.dtype)  # noqa: B023, E731
        row = {"seg": r["seg"], "bucket": r["bucket"], "codes": enc(pick(level.codes, np.uint16(Level.NONE))), "known": len(sums), "ranks": None, "counts": None}
        if not last:
            row |= {"ranks": _gaps(found), "counts": enc(pick(sums, 0))}
        yield row


ASKED = "bucket int, seg long, contexts binary, words binary, counts binary, totals binary"
ANSWER = "seg long, bucket int, codes binary, known long, ranks binary, counts binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORED: for each document the log10 probability under the model, and under its bottom alone."""
    segs = Segments(docs, id_col, text_col, form=_tokenised)
    words = by_bucket(segs.emit(_emit_words, "bucket int, seg long, keys binary, counts binary"), _count_words, WORDS, "words", segs.buckets)
    v = _Vocabulary(words, strength)
    answers = words.select("seg", "bucket", F.lit(1).alias("level"), F.lit(None).cast("binary").alias("codes"), "ranks", "counts")

    for level in range(2, order + 1):
        last = level == order
        led = answers.withColumn("codes", F.lit(None).cast("binary"))  # probabilities lead to no context
        asked = segs.with_answers(led, lambda s, got, buckets, level=level: _ask(s, got, v, buckets, level), ASKED)
        found = by_bucket(asked, lambda rows, last=last: _build(rows, strength, last), ANSWER, "trie", segs.buckets)
        if not last:
            v.levels[level] = _Ids(found, 0)
        answers = answers.unionByName(found.select("seg", "bucket", F.lit(level).alias("level"), "codes", "ranks", "counts"))

    return segs.with_answers(answers, lambda s, got, buckets: _finish(s, got, v, buckets, order), SCORED)
