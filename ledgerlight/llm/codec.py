"""Compact binary columns for numpy arrays: byte planes under zstd."""

from __future__ import annotations

import numpy as np
import zstandard


def enc(a: np.ndarray) -> bytes:
    """Any fixed-width array. Bytes of equal weight stand together, so that rarely used ones cost nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def dec(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def enc_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64: gaps only."""
    return enc(np.diff(a, prepend=np.uint64(0)))


def dec_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(dec(raw, np.uint64), dtype=np.uint64)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)
