"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts each text where its top bits are zero, so a cut depends on nearby bytes
alone and an insertion moves no cut beyond the chunks around it. Where no such place comes for CALM bytes, as in words
repeated without end, the places whose hash is the lowest of the last CALM cut; a period has the same ones at any phase.
Chunks are compared by a 128-bit
digest over all documents. A chunk is a repeat if its digest also occurs in a document with a smaller doc_id;
runs of neighbouring repeats are removed if they span MIN_RUN bytes or the whole text.

Null and empty texts have no chunks. Documents with equal ids do not make each other repeats; a null id counts
as larger than every other. Columns besides those named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .codec import dec, dec_sorted, enc, enc_sorted
from .segments import Seg, Segments, by_bucket, split
from .tokens import U64

#: Shortest and longest chunk in bytes; a cut stands at one of 2**BITS places on average.
LEAST, MOST, BITS = 16, 256, 4
#: Bytes without a cut among which the lowest hash cuts; a power of two.
CALM = 64
#: Shortest run of repeats that is removed, in bytes.
MIN_RUN = 64
_GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256).astype(np.uint16)


def cuts(blob: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Places behind which the gear hash of the last 16 bytes cuts: those with zeros on top, and those with the lowest
    hash of the last CALM bytes. Texts begin at starts; by default the blob is one text."""
    h = _GEAR[blob]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    low, k = h.copy(), 1
    while k < CALM:
        low[k:] = np.minimum(low[k:], low[:-k])
        k *= 2
    zero = h >> np.uint16(16 - BITS) == 0
    at = np.flatnonzero(zero | (h == low)) + 1
    starts = np.zeros(1, np.int64) if starts is None else starts
    inside = at - starts[np.searchsorted(starts, at - 1, "right") - 1]
    return at[zero[at - 1] | (inside >= CALM + 16 - 1)]  # as many bytes as the lowest of CALM hashes looks at


def chunk_ends(n: int, cut: list[int]) -> list[int]:
    """Ends of the chunks of a text of n bytes with these ascending places to cut."""
    out, last = [], 0
    for c in [*cut, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST and c < n:
            out.append(c)
            last = c
    if n and (not out or out[-1] < n):
        if out and n - out[-1] < LEAST:
            out.pop()
        out.append(n)
    return out


class _Chunks:
    def __init__(self, s: Seg):
        at = cuts(s.blob, s.starts)
        doc = np.searchsorted(s.starts, at - 1, "right") - 1
        bounds = np.searchsorted(doc, np.arange(len(s.ids) + 1))
        local = (at - s.starts[doc]).tolist() if len(at) else []
        ends, counts, digests = [], [], []
        raw = s.blob.tobytes()
        for d, (start, n) in enumerate(zip(s.starts.tolist(), s.lens.tolist(), strict=True)):
            own = chunk_ends(n, [c for c in local[bounds[d] : bounds[d + 1]] if c < n])
            a = start
            for e in own:
                digests.append(hashlib.blake2b(raw[a : start + e], digest_size=16).digest())
                a = start + e
            ends += own
            counts.append(len(own))
        self.counts, self.ends = np.array(counts, np.int64), np.array(ends, np.int64)
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        both = np.frombuffer(b"".join(digests), U64).reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(1)
        self.hi, self.lo = both[new, 0], both[new, 1]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.least = np.full(len(self.hi), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.place, s.order[self.doc])


def _emit(s: Seg, buckets: int):
    c = _Chunks(s)
    at = split(c.hi, buckets)
    for b in range(buckets):
        x = slice(at[b], at[b + 1])
        if x.stop > x.start:
            yield {"bucket": b, "seg": s.seg, "hi": enc_sorted(c.hi[x]), "lo": enc(c.lo[x]), "least": enc(c.least[x])}


def _settle(rows: list[dict]):
    """The least doc_id of each digest, for each segment that asks."""
    hi = [dec_sorted(r["hi"]) for r in rows]
    sizes = np.cumsum([0, *map(len, hi)])
    hi, lo, least = np.concatenate(hi), np.concatenate([dec(r["lo"], U64) for r in rows]), np.concatenate([dec(r["least"], np.int64) for r in rows])
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    first = np.minimum.reduceat(least[order], np.flatnonzero(new))
    least[order] = first[np.cumsum(new) - 1]
    for r, a, b in zip(rows, sizes[:-1], sizes[1:], strict=True):
        yield {"seg": r["seg"], "bucket": r["bucket"], "least": enc(least[a:b])}


SPANS = "doc_id long, n_bytes long, n_chunks long, n_repeats long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>"


def _apply(s: Seg, answers: list[dict], buckets: int):
    c = _Chunks(s)
    least = np.concatenate([dec(r["least"], np.int64) for r in answers]) if answers else np.zeros(0, np.int64)
    repeat = least[c.place] < s.order[c.doc] if len(c.place) else np.zeros(0, bool)
    raw, k = s.blob.tobytes(), 0
    out: dict[str, list] = {n.split()[0]: [] for n in SPANS.split(", ")}
    for d, (start, n, m) in enumerate(zip(s.starts.tolist(), s.lens.tolist(), c.counts.tolist(), strict=True)):
        ends, mine = c.ends[k : k + m], repeat[k : k + m]
        k += m
        flank = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0])).astype(np.int8)))
        begin = np.concatenate(([0], ends))
        spans = [(int(begin[a]), int(begin[z])) for a, z in zip(flank[::2], flank[1::2], strict=True)]
        spans = [(a, z) for a, z in spans if z - a >= MIN_RUN or z - a == n]
        kept, at = hashlib.sha256(), 0
        for a, z in [*spans, (n, n)]:
            kept.update(raw[start + at : start + a])
            at = z
        for name, v in (("doc_id", s.ids[d]), ("n_bytes", n), ("n_chunks", m), ("n_repeats", int(mine.sum())), ("n_removed", sum(z - a for a, z in spans)), ("n_spans", len(spans)), ("kept_sha256", kept.hexdigest()), ("spans", [x for y in spans for x in y])):
            out[name].append(v)
    yield out


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with what of it repeats: SPANS holds the columns; spans are byte offsets."""
    segs = Segments(docs, id_col, text_col)
    asked = segs.emit(_emit, "bucket int, seg long, hi binary, lo binary, least binary")
    answers = by_bucket(asked, _settle, "seg long, bucket int, least binary", "chunks", segs.buckets)
    return segs.with_answers(answers, _apply, SPANS)
