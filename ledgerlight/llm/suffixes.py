"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost-smaller suffixes (LMS:
an S behind an L) are sorted first: their substrings by inducing from arbitrary order, then, where substrings repeat,
recursively by their names. From the sorted LMS suffixes all others are induced in one pass over the buckets for the
L's and one for the S's. A pass handles one byte's bucket at a time, as waves of arrays. Below the first level the
alphabet is the set of names, with nearly as many buckets as suffixes; there, names are refined by pairs, doubling
their reach, until all differ, which sorts the same suffixes of names.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the end of s counts as smaller than everything."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    rises = s[1:][differs] > s[:-1][differs]
    # the next place at or behind i where neighbours differ decides; behind the last one the end does
    at = np.searchsorted(differs, np.arange(n))
    return np.append(rises, False)[at]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> list[list[np.ndarray]]:
    """Places of all suffixes in runs by bucket: [L runs ascending, S runs descending] for each byte."""
    lms = lms.astype(np.int32)
    first = s[lms]
    bounds = np.searchsorted(first, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]

    def push(places: np.ndarray, want: bool, to: list[list[np.ndarray]]) -> None:
        before = places[places > 0] - 1
        before = before[small[before] == want]
        if not len(before):
            return
        byte = s[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(before, cut) if len(cut) else (before,):
            to[s[part[0]]].append(part)

    push(np.array([len(s)], np.int32), False, larger)
    def drain(c: int, want: bool, to: list[list[np.ndarray]]) -> None:
        """Pushes what the bucket holds, then what that put into the same bucket, and so on."""
        k, done = 0, []
        while k < len(to[c]):
            wave = np.concatenate(to[c][k:])
            k = len(to[c])
            done.append(wave)
            push(wave, want, to)
        to[c] = done

    for c in range(256):
        drain(c, False, larger)
        push(lms[bounds[c] : bounds[c + 1]], False, larger)
    for c in range(255, -1, -1):
        drain(c, True, smaller)
        if larger[c]:
            push(np.concatenate(larger[c])[::-1], True, smaller)
    return [larger, smaller]


def _array(runs: list[list[list[np.ndarray]]]) -> np.ndarray:
    larger, smaller = runs
    parts: list[np.ndarray] = []
    for c in range(256):
        parts += larger[c]
        parts += [run[::-1] for run in reversed(smaller[c])]
    return np.concatenate(parts)


def words_at(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros behind the end."""
    padded = np.concatenate([s, np.zeros(16, np.uint8)])
    return np.ndarray(len(s) + 8, "<u8", padded, strides=(1,))


def _names(word: np.ndarray, lms: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the LMS substrings, which order lists ascending; equal substrings share one. In the order of lms."""
    size = np.diff(lms, append=n) + 1  # up to and with the next LMS byte
    length = np.zeros(n, np.int32)
    length[lms] = size
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    reach, live = 0, np.flatnonzero(same)
    while len(live):
        left = length[a[live]] - reach
        x = word[a[live] + reach] ^ word[b[live] + reach]
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.clip(left, 0, 7) * 8).astype(np.uint64)) - np.uint64(1))
        equal = (x & mask) == 0
        same[live[~equal]] = False
        reach += 8
        live = live[equal & (left > 8)]
    if len(order):
        last = order == lms[-1]  # the last one ends with the text and equals no other
        same[last[1:] | last[:-1]] = False
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(~same)))
    return rank[lms]


def sort_names(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of ranks: names of pairs, then of pairs of pairs, until all differ."""
    m = len(rank)
    order = np.argsort(rank, kind="stable")
    k = 1
    # the name of a suffix is the place where its group begins, so that settled names stay what they are
    s = rank[order]
    new = np.ones(m, bool)
    new[1:] = s[1:] != s[:-1]
    name = np.empty(m, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    name[order] = start
    while True:
        alone = new & np.append(new[1:], True)
        live = np.flatnonzero(~alone)
        if not len(live):
            return order
        some = order[live]
        follow = np.where(some + k < m, name[np.minimum(some + k, m - 1)] + 1, 0)
        by = np.lexsort((follow, name[some]))
        some, follow = some[by], follow[by]
        order[live] = some
        group = name[some]
        split = np.ones(len(some), bool)
        split[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[live] = split
        name[some] = np.maximum.accumulate(np.where(split, live, 0))
        k *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of s (uint8) in ascending order."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _array(_induce(s, small, lms)).astype(np.int32)
    rough = _array(_induce(s, small, lms[np.argsort(s[lms], kind="stable")]))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    rank = _names(words_at(s), lms, rough, n)
    del rough, is_lms
    return _array(_induce(s, small, lms[sort_names(rank)])).astype(np.int32)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the length that its suffix shares with the next smaller suffix, and where that one stands (-1
    for the smallest). Lengths are compared only where the bytes before the two differ; elsewhere they are one less
    than at the place before."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    before = np.zeros(n, bool)
    both = (at > 0) & (phi > 0)
    before[both] = s[at[both] - 1] == s[phi[both] - 1]
    hard = np.flatnonzero(~before)
    length = np.zeros(len(hard), np.int64)
    word = words_at(s)
    live = np.flatnonzero(phi[hard] >= 0)
    while len(live):
        a, b = hard[live] + length[live], phi[hard[live]] + length[live]
        room = n - np.maximum(a, b)
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        zeros = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        step = np.minimum(np.where(x == 0, 8, zeros), room)
        length[live] += step
        live = live[(step == 8) & (room > 8)]
    high = np.zeros(n, np.int64)
    high[hard] = length + hard
    source = np.maximum.accumulate(np.where(~before, at, 0))
    return high[source] - at, phi
