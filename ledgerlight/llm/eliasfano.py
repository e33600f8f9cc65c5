"""Elias-Fano sequences and n-gram trie levels in one mapped block of memory, read in place by arrays of queries. Where
queries are about as many as values, the unary bits are scanned once instead of a search for each query."""

from __future__ import annotations

import mmap

import numpy as np

from .tokens import U64

#: 64-bit words of unary bits for which one running count is kept.
BLOCK = 8
#: Values for each query up to which the unary bits are scanned.
SCAN = 8


class Sequence:
    """An ascending sequence of uint64: low bits packed, high bits in unary, about 2 + log2(universe / n) bits each.
    Nothing is unpacked; besides the bits there is a count of ones for each BLOCK words."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        """low: bytes, with eight to spare; high: whole blocks of 64-bit words."""
        self.n, self.width, self._high = n, width, high
        self._low = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
        self._before = None

    def _counts(self, ones: bool) -> np.ndarray:
        """The ones, or zeros, before each block."""
        if self._before is None:
            n = np.bitwise_count(self._high).reshape(-1, BLOCK).sum(1, dtype=np.int64)
            self._before = np.cumsum(n) - n
        return self._before if ones else np.arange(len(self._before)) * (64 * BLOCK) - self._before

    def _scan(self, ones: bool) -> np.ndarray:
        """The places of all ones, or zeros, of the high bits."""
        bits = np.unpackbits(self._high.view(np.uint8), bitorder="little").view(bool)
        return np.flatnonzero(bits if ones else ~bits)

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """n, width, packed low bits, words of high bits: bit i + (high part of value i) is set."""
        n = len(values)
        width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        width = min(width, 56)  # a value is read from one unaligned word
        bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(n, 8), axis=1, count=width, bitorder="little") if width else np.zeros(0, np.uint8)
        low = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        at = (values >> U64(width)).astype(np.int64) + np.arange(n)
        size = int(at[-1]) + 2 if n else 1  # a zero ends the last high part
        high = np.zeros(-(-size // (64 * BLOCK)) * 64 * BLOCK, np.uint8)
        high[at] = 1
        return n, width, low, np.packbits(high, bitorder="little").view("<u8")

    def low(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(np.int64) * self.width
        return (self._low[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one, or zero, of the high bits."""
        if len(k) * SCAN >= self.n:
            return self._scan(ones)[k]
        before = self._counts(ones)
        block = np.searchsorted(before, k, "right") - 1
        left, word = k - before[block], block * BLOCK
        flip = U64(0) if ones else ~U64(0)
        for _ in range(BLOCK - 1):
            n = np.bitwise_count(self._high[word] ^ flip)
            go = left >= n
            left = left - n * go
            word = word + go
        x, at = self._high[word] ^ flip, word * 64
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(x & U64((1 << half) - 1))
            go = left >= n
            left = left - n * go
            x = x >> (go * U64(half))
            at = at + go * half
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return ((self._select(i, True) - i).astype(U64) << U64(self.width)) | self.low(i)

    def _run(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of the values with each high part."""
        most = len(self._high) * 64 - self.n  # zeros
        if len(top) * SCAN >= self.n:
            upto = np.zeros(most + 1, np.int64)
            upto[1:] = self._scan(False) - np.arange(most)
            at = np.minimum(top, most)
            return upto[at], upto[np.minimum(at + 1, most)]
        a, z = (np.where(t < 0, 0, np.where(t >= most, self.n, self._select(np.clip(t, 0, most - 1), False) - t)) for t in (top - 1, top))
        return a, z

    def _search(self, x: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """successor(), and whether it is x."""
        top = np.minimum(x >> U64(self.width), U64(1 << 62)).astype(np.int64)
        a, z = self._run(top)
        if lo is not None:
            a, z = np.clip(a, lo, hi), np.clip(z, lo, hi)
        target = x & U64((1 << self.width) - 1)
        end, live = z, np.flatnonzero(a < z)
        z = z.copy()
        while len(live):
            p, q = a[live], z[live]
            mid = (p + q) >> 1
            less = self.low(mid) < target[live]
            a[live] = p = np.where(less, mid + 1, p)
            z[live] = q = np.where(less, q, mid)
            live = live[p < q]
        here = np.flatnonzero(a < end)  # inside the run, so that its high part is that of x
        equal = np.zeros(len(x), bool)
        equal[here] = self.low(a[here]) == target[here]
        return a, equal

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The first place in [lo, hi) whose value is x at least; hi if there is none. Defaults: the whole sequence."""
        return self._search(x, lo, hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of x in [lo, hi), -1 where it isn't."""
        if not self.n:
            return np.full(len(x), -1)
        at, equal = self._search(x, lo, hi)
        return np.where(equal, at, -1)


class Level:
    """One level of the trie: parents (places of the level above), monotone pointers to their children, the children,
    and a quantised log10 probability of each child. Children stand relative to their parent: each parent's are raised
    above those of the one before, which makes them one ascending sequence. A child's place is what the level below
    has as its parent."""

    #: Quantisation of log10 probabilities: 16 bits over 16 decades.
    STEP, NONE = 16 / 65534, 65535

    def __init__(self, raw):
        """raw: what pack() made, in any buffer (bytes, a mapped file)."""
        self._raw = np.frombuffer(raw, np.uint8)
        head = self._raw[: 8 * 11].view(np.int64)
        at, parts = 88, []
        for n, width, low, high in head[:9].reshape(3, 3)[:, [0, 1, 2, 2]].tolist():
            size = (n * width + 7) // 8 + 8
            size += -size % 8
            parts.append(Sequence(n, width, self._raw[at : at + size], self._raw[at + size : at + size + high].view("<u8")))
            at += size + high
        self.contexts, self.pointers, self.children = parts
        self.span = int(head[9])
        self.codes = self._raw[at:].view(np.uint16)

    @classmethod
    def pack(cls, context: np.ndarray, child: np.ndarray, log10: np.ndarray) -> bytes:
        """From entries ordered by context and child."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        rank = np.cumsum(new) - 1
        span = int(child.max()) + 1 if len(child) else 1
        first = np.append(np.flatnonzero(new), len(context)).astype(U64)
        head, body = [], []
        for values in (context[new], first, rank.astype(U64) * U64(span) + child.astype(U64)):
            n, width, low, high = Sequence.parts(values)
            low = low[: (n * width + 7) // 8 + 8].tobytes()
            head += [n, width, high.nbytes]
            body += [low + b"\0" * (-len(low) % 8), high.tobytes()]
        return np.array([*head, span, 0], np.int64).tobytes() + b"".join(body) + cls.coded(log10).tobytes()

    @classmethod
    def coded(cls, log10: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(-log10 / cls.STEP), 0, cls.NONE - 1).astype(np.uint16)

    @classmethod
    def mapped(cls, raw: bytes) -> Level:
        """The level in memory of its own, which goes back to the system as soon as the level is dropped."""
        block = mmap.mmap(-1, len(raw))
        block.write(raw)
        return cls(block)

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The place of each (context, child); -1 where the trie has it not."""
        out = np.full(len(context), -1)
        if not self.contexts.n or not len(context):
            return out
        new = np.append(True, context[1:] != context[:-1])  # runs of one context are looked up once
        run = np.cumsum(new) - 1
        rank = self.contexts.find(context[new])
        there = np.maximum(rank, 0)
        lo, hi = self.pointers.get(np.append(there, there + 1)).astype(np.int64).reshape(2, -1)
        known = np.flatnonzero((rank[run] >= 0) & (child < self.span))
        run = run[known]
        out[known] = self.children.find(rank[run].astype(U64) * U64(self.span) + child[known].astype(U64), lo[run], hi[run])
        return out

    def lookup(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The code of each (context, child); NONE where the trie has it not."""
        at = self.find(context, child)
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], np.uint16(self.NONE)) if len(self.codes) else np.full(len(at), self.NONE, np.uint16)
