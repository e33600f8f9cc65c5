"""Tokenising and hashing whole batches of UTF-8 text with numpy.

A batch is one uint8 array in which every text is followed by one line feed, which no token contains.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
#: Bytes of words that are hashed at once.
AT_ONCE = 1 << 18


def _fold(word: np.ndarray) -> np.ndarray:
    """Byte -> lower-cased byte + 1 inside words, 0 elsewhere (uint16, as byte 255 takes 256)."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[~word] = 0
    return table


def _alnum_bytes() -> np.ndarray:
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return word


def _solid_bytes() -> np.ndarray:
    word = np.ones(256, bool)
    word[32] = word[9:14] = False
    return word


#: Words of ASCII letters, digits and every code point from 128 on, A-Z lower-cased.
ALNUM = _fold(_alnum_bytes())
#: Runs without white space (space, 9 to 13), A-Z lower-cased.
SOLID = _fold(_solid_bytes())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (the splitmix64 finaliser's shape with our own shifts)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * _ODD
    return x ^ (x >> U64(32))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    x = x ^ (x >> U64(32))
    x = x * U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    x = x ^ (x >> U64(29)) ^ (x >> U64(58))
    x = x * U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    return x ^ (x >> U64(31)) ^ (x >> U64(62))


_WEIGHTS = np.zeros(0, U64)


def _weights(n: int) -> np.ndarray:
    """An odd weight for each place in a word. They are unrelated: with powers of one number, words of a regular
    build (the Thue-Morse word and its complement, say) have equal hashes."""
    global _WEIGHTS
    if len(_WEIGHTS) < n:
        _WEIGHTS = mix(np.arange(max(n, 256), dtype=U64) * _ODD + U64(0xA24BAED4963EE407)) | U64(1)
    return _WEIGHTS


def _hashes(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each word of x; what stands between words is 0 and adds nothing."""
    run = np.diff(starts, append=len(x))
    at = np.arange(len(x)) - np.repeat(starts, run)
    return mix(np.add.reduceat(x * _weights(int(run.max()))[at], starts))


class Words:
    """Tokens of a batch: starts, ends (byte offsets), hash (uint64), doc (index of the text)."""

    __slots__ = ("starts", "ends", "hash", "doc", "counts")

    def __init__(self, blob: np.ndarray, lens: np.ndarray, table: np.ndarray):
        """lens: bytes of each text; text i stands at sum(lens[:i] + 1)."""
        inside = np.zeros(len(blob) + 2, np.int8)
        inside[1:-1] = (table > 0)[blob]
        edge = np.flatnonzero(np.diff(inside))
        del inside
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hash = np.empty(len(self.starts), U64)
        a = 0
        while a < len(self.starts):  # some bytes at once, as a byte takes many while it is hashed
            z = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + AT_ONCE)))
            self.hash[a:z] = _hashes(table[blob[self.starts[a] : self.ends[z - 1]]], self.starts[a:z] - self.starts[a])
            a = z
        bounds = np.cumsum(lens + 1)
        self.doc = np.searchsorted(bounds, self.starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(lens))


def order_by(*keys: np.ndarray) -> np.ndarray:
    """The stable order by arrays of numbers from 0 on, the first one first. Numbers are packed with their places into
    one word, which sorts many times faster than places do; what does not fit is sorted the long way."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    place = U64(max(n - 1, 1).bit_length())
    spot = np.arange(n, dtype=U64)
    head, bits = keys[0].astype(U64), int(keys[0].max()).bit_length()

    def ranked():
        packed = np.sort((head << place) | spot)
        order = (packed & ((U64(1) << place) - U64(1))).astype(np.int64)
        packed >>= place
        out = np.empty(n, U64)
        out[order] = np.cumsum(np.append(False, packed[1:] != packed[:-1]))
        return out, int(out.max()).bit_length()

    for k in keys[1:]:
        more = int(k.max()).bit_length()
        if bits + more + int(place) > 64 >= bits + int(place):
            head, bits = ranked()
        if bits + more + int(place) > 64:
            return np.lexsort(keys[::-1])
        head, bits = (head << U64(more)) | k.astype(U64), bits + more
    if bits + int(place) > 64:
        return np.argsort(head, kind="stable")
    return (np.sort((head << place) | spot) & ((U64(1) << place) - U64(1))).astype(np.int64)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays of numbers from 0 on, ascending, and for each pair the place of its value."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, mid = U64(max(n - 1, 1).bit_length()), U64(int(b.max()).bit_length())
    new = np.ones(n, bool)
    if int(a.max()).bit_length() + int(mid) + int(low) <= 64:
        packed = a.astype(U64) << mid
        packed |= b.astype(U64)
        packed <<= low
        packed |= np.arange(n, dtype=U64)
        packed.sort()
        order = (packed & ((U64(1) << low) - U64(1))).astype(np.int64)
        packed >>= low
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        pairs = packed[new]
        out = (pairs >> mid).astype(np.int64), (pairs & ((U64(1) << mid) - U64(1))).astype(np.int64)
    else:
        order = order_by(a, b)
        x, y = a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        out = x[new].astype(np.int64), y[new].astype(np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return *out, place


def _hash_order(keys: np.ndarray) -> np.ndarray:
    """The order of hashes: by their upper bits, with places in the lower ones, unless those decide."""
    mask = (U64(1) << U64(max(len(keys) - 1, 1).bit_length())) - U64(1)
    order = (np.sort((keys & ~mask) | np.arange(len(keys), dtype=U64)) & mask).astype(np.int64)
    s = keys[order]
    return np.argsort(keys) if (s[1:] < s[:-1]).any() else order


def uniques(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their counts, and for each key the place of its value."""
    order = _hash_order(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], np.diff(at, append=len(s)), place


def find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in sorted_keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)
