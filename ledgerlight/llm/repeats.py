"""Substring dedup with suffix arrays: bytes covered by a long string that a smaller doc_id also holds.

Documents can't all be in one suffix array, so windows of LENGTH bytes are dealt to shards by content. The anchor of
a window is its GRAM bytes of the least hash (the leftmost of equals); equal windows have equal anchors, and
neighbouring windows mostly share theirs, so they travel as one string of at most 2 * LENGTH - GRAM bytes. A first
exchange finds the anchors that occur in more than one document; only strings around those are dealt. A shard sorts
the suffixes of its distinct strings by induced sorting, reads equal windows off the permuted common prefixes, and
answers for each string and segment which windows also start in a document of a smaller id than the least that has the
string there; so a line that every document holds costs an entry a segment. Anchors and hashes only choose what is
compared; equality is decided by the suffix arrays.

Null and empty texts have no bytes. Documents with equal ids do not remove each other's bytes; a null id counts as
larger than every other. Repeated rows give a row each; extra columns are not read. An empty table gives no rows; a
long text is a segment of its own, and is compared whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .codec import dec, dec_sorted, enc, enc_sorted, expand, squeeze
from .segments import Seg, Segments, by_bucket, split, trim
from .suffixes import permuted_lcp, suffix_array
from .tokens import U64, find, mix, uniques

LENGTH, GRAM = 50, 20
LOW = U64(0xFFFFFFFF)
#: Bytes of strings in one suffix array, about; sorting takes some hundred times as much memory.
SHARD_BYTES = 1 << 20
#: Bytes whose windows are hashed at once, so that the arrays stay in the processor's cache.
AT_ONCE = 1 << 17
_MUL = U64(0xA24BAED4963EE407)


def _grams(x: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on, from hashes of 1, 2, 4, 8 and 16 bytes."""
    power = lambda k: U64(pow(int(_MUL), k, 1 << 64))
    h, have, size, out = x.astype(U64) + U64(1), 0, 1, None
    left = GRAM
    while left:
        if left & 1:
            out = h if out is None else out[: len(h) - have] * power(size) + h[have:] if have else h
            have += size
        left >>= 1
        if left:
            h = h[:-size] * power(size) + h[size:]
            size *= 2
    return mix(out)


class Strings:
    """The strings of a segment's windows: first window and last window (places in the blob), document, anchor."""

    def __init__(self, s: Seg):
        parts = []
        a, n = 0, len(s.lens)
        while a < n:
            z = max(a + 1, int(np.searchsorted(s.starts, s.starts[a] + AT_ONCE)))
            parts.append(self._chunk(s, a, z))
            a = z
        self.first, self.last, self.doc, self.anchor = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _chunk(s: Seg, a: int, z: int):
        lens, starts = s.lens[a:z], s.starts[a:z]
        base = int(starts[0])
        x = s.blob[base : int(starts[-1] + lens[-1])]
        full = np.flatnonzero(lens >= LENGTH)
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        h = _grams(x)
        v = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        wide, size = LENGTH - GRAM + 1, 1
        while size * 2 <= wide:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < wide:
            v = np.minimum(v[: len(v) - (wide - size)], v[wide - size :])
        at = (v & U64(0xFFFFFFFF)).astype(np.int64)  # anchor of the window from each place on
        begin, count = starts[full] - base, lens[full] - LENGTH + 1
        edge = np.zeros(len(at) + 1, np.int8)
        edge[begin] += 1
        edge[begin + count] -= 1
        valid = np.cumsum(edge[:-1]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        new[begin] = True
        end = valid.copy()
        end[:-1] &= ~valid[1:] | new[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        # hashed once more: the least of many hashes is small, and would meet the others of its kind in the first buckets
        return first + base, last + base, a + full[np.searchsorted(begin, first, "right") - 1], mix(h[at[first]])


def _emit(s: Seg, buckets: int):
    t = Strings(s)
    keys, _, place = uniques(t.anchor)
    low = np.full(len(keys), len(s.ids))
    high = np.full(len(keys), -1)
    np.minimum.at(low, place, t.doc)
    np.maximum.at(high, place, t.doc)
    at = split(keys, buckets)
    for b in range(buckets):
        x = slice(at[b], at[b + 1])
        if x.stop > x.start:
            yield {"bucket": b, "seg": s.seg, "keys": enc_sorted(keys[x]), "many": squeeze(np.packbits(low[x] < high[x]).tobytes())}


def _shared(rows: list[dict]):
    """Which anchors of each segment occur in more than one document."""
    keys = [dec_sorted(r["keys"]) for r in rows]
    size = np.cumsum([0, *map(len, keys)])
    many = np.concatenate([np.unpackbits(np.frombuffer(expand(r["many"]), np.uint8))[: len(k)] for r, k in zip(rows, keys, strict=True)])
    _, count, place = uniques(np.concatenate(keys))
    shared = ((count > 1) | (np.bincount(place, many) > 0))[place]
    for r, a, z in zip(rows, size[:-1], size[1:], strict=True):
        yield {"seg": r["seg"], "bucket": r["bucket"], "shared": squeeze(np.packbits(shared[a:z]).tobytes()), "masks": None}


class _Wanted:
    """The strings of a segment around shared anchors, each text once, and where they stand."""

    def __init__(self, s: Seg, answers: list[dict], buckets: int):
        t = Strings(s)
        keys, _, place = uniques(t.anchor)
        at = split(keys, buckets)
        shared = np.zeros(len(keys), bool)
        for r in answers:
            b = r["bucket"]
            shared[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(expand(r["shared"]), np.uint8))[: at[b + 1] - at[b]]
        pick = np.flatnonzero(shared[place])
        self.first, self.last, self.doc, anchor = t.first[pick], t.last[pick], t.doc[pick], t.anchor[pick]
        raw = s.blob.tobytes()
        seen: dict[bytes, int] = {}
        text = [seen.setdefault(raw[a:z], len(seen)) for a, z in zip(self.first.tolist(), (self.last + LENGTH).tolist(), strict=True)]
        self.texts = list(seen)
        # one question for each text, with the least id that has it here: in documents of larger ids all its windows
        # repeat that one's, wherever else they are
        self.text = np.array(text, np.int64)
        ids = s.order[self.doc]
        self.id = np.full(len(self.texts), np.iinfo(np.int64).max)
        np.minimum.at(self.id, self.text, ids)
        self.later = ids > self.id[self.text]
        self.bucket, self.part = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.uint64)
        self.bucket[self.text] = ((anchor >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        self.part[self.text] = anchor & LOW


def _deal(s: Seg, answers: list[dict], buckets: int):
    w = _Wanted(s, answers, buckets)
    order = np.argsort(w.bucket, kind="stable")
    at = np.searchsorted(w.bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        q = order[at[b] : at[b + 1]]
        if len(q):
            own = [w.texts[k] for k in q.tolist()]
            yield {"bucket": b, "seg": s.seg, "texts": squeeze(b"".join(own)), "lens": enc(np.array([len(x) for x in own], np.int32)), "parts": enc(w.part[q]), "ids": enc(w.id[q])}


def _least_ids(strings: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each string the least id, over all strings, of those that hold each of its windows."""
    lens = np.array([len(x) for x in strings])
    s = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)  # no UTF-8 text holds byte 255, the separator: it becomes 0
    start = np.cumsum(lens + 1) - lens - 1
    sa = suffix_array(s)
    shares, _ = permuted_lcp(s, sa)
    owner = np.repeat(np.arange(len(lens)), lens + 1)
    whole = np.arange(len(s)) - start[owner] <= (lens - LENGTH)[owner]
    sa = sa[whole[sa]]  # what stands between two equal windows is a window too
    new = shares[sa] < LENGTH
    new[0] = True
    group = np.cumsum(new) - 1
    low = np.minimum.reduceat(least[owner[sa]], np.flatnonzero(new))
    out = np.empty(len(s), np.int64)
    out[sa] = low[group]
    return [out[a : a + n - LENGTH + 1] for a, n in zip(start.tolist(), lens.tolist(), strict=True)]


def _answer(rows: list[dict]):
    """Sorts a bucket's distinct strings in shards of bounded size; strings with one anchor are in one shard."""
    seen: dict[bytes, int] = {}
    part: list[int] = []
    asked = []
    for r in rows:
        raw, at, k = expand(r["texts"]), 0, []
        for n, p in zip(dec(r["lens"], np.int32).tolist(), dec(r["parts"], np.uint64).tolist(), strict=True):
            k.append(seen.setdefault(raw[at : at + n], len(seen)))
            at += n
            if len(part) < len(seen):
                part.append(p)
        asked.append((np.array(k, np.int64), dec(r["ids"], np.int64)))
    text, ids = np.concatenate([a for a, _ in asked]), np.concatenate([b for _, b in asked])
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, text, ids)
    shards = -(-sum(map(len, seen)) // SHARD_BYTES)
    shard_of = (np.array(part, np.uint64) % U64(shards)).astype(np.int64)
    strings = list(seen)
    del seen, part
    masks = np.zeros(len(text), U64)
    for shard in range(shards):
        own = np.flatnonzero(shard_of == shard)
        if not len(own):
            continue
        low = _least_ids([strings[i] for i in own.tolist()], least[own])
        count = np.array([len(x) for x in low])
        offset, flat = np.cumsum(count) - count, np.concatenate(low)
        asks = np.flatnonzero(shard_of[text] == shard)
        mine, mark = np.searchsorted(own, text[asks]), np.zeros(len(asks), U64)
        for bit in range(int(count.max())):
            has = np.flatnonzero(count[mine] > bit)
            mark[has] |= (flat[offset[mine[has]] + bit] < ids[asks[has]]).astype(U64) << U64(bit)
        masks[asks] = mark
        trim()
    at = 0
    for r, (k, _) in zip(rows, asked, strict=True):
        yield {"seg": r["seg"], "bucket": r["bucket"], "shared": None, "masks": enc(masks[at : at + len(k)])}
        at += len(k)


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>"


def _apply(s: Seg, answers: list[dict], buckets: int):
    w = _Wanted(s, [r for r in answers if r["shared"]], buckets)
    masks = np.zeros(len(w.texts), U64)
    order = np.argsort(w.bucket, kind="stable")
    got = [dec(r["masks"], U64) for r in answers if r["masks"]]
    if got:
        masks[order] = np.concatenate(got)
    edge = np.zeros(len(s.blob) + LENGTH + 1, np.int32)
    mine = np.where(w.later, (U64(1) << (w.last - w.first + 1).astype(U64)) - U64(1), masks[w.text])
    for bit in range(LENGTH - GRAM + 1):
        at = w.first[(mine >> U64(bit)) & U64(1) == 1] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
    gone = np.cumsum(edge[: len(s.blob)]) > 0
    flank = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
    begin, end = flank[::2], flank[1::2]
    bounds = np.searchsorted(begin, np.append(s.starts, len(s.blob)))
    raw = s.blob.tobytes()
    out: dict[str, list] = {x.split()[0]: [] for x in SPANS.split(", ")}
    for d, (start, n) in enumerate(zip(s.starts.tolist(), s.lens.tolist(), strict=True)):
        spans = [(int(a) - start, int(z) - start) for a, z in zip(begin[bounds[d] : bounds[d + 1]], end[bounds[d] : bounds[d + 1]], strict=True)]
        kept, at = hashlib.sha256(), 0
        for a, z in [*spans, (n, n)]:
            kept.update(raw[start + at : start + a])
            at = z
        for name, v in (("doc_id", s.ids[d]), ("n_bytes", n), ("n_removed", sum(z - a for a, z in spans)), ("n_spans", len(spans)), ("kept_sha256", kept.hexdigest()), ("spans", [x for y in spans for x in y])):
            out[name].append(v)
    yield out


ANSWER = "seg long, bucket int, shared binary, masks binary"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with the byte spans that are covered by repeats: SPANS holds the columns."""
    segs = Segments(docs, id_col, text_col, spread=4)
    shared = by_bucket(segs.emit(_emit, "bucket int, seg long, keys binary, many binary"), _shared, ANSWER, "anchors", segs.buckets)
    dealt = segs.with_answers(shared, _deal, "bucket int, seg long, texts binary, lens binary, parts binary, ids binary")
    masks = by_bucket(dealt, _answer, ANSWER, "masks", segs.buckets)
    return segs.with_answers(shared.unionByName(masks), _apply, SPANS)
