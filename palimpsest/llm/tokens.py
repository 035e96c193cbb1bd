"""Hashes of words and shingles of texts as arrays."""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_hash = partial(xxhash.xxh64_intdigest, seed=0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    w = text.split()
    return np.fromiter(map(_hash, w), dtype=np.uint64, count=len(w))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _A + h[k : k + n]
    return mix(out)
