"""Hashed counts of byte n-grams."""

from __future__ import annotations

import numpy as np


def hashed_ngrams(data: bytes, orders=(1, 2, 3), bits: int = 12) -> np.ndarray:
    """Counts of the n-grams of data in 2**bits buckets."""
    out = np.zeros(1 << bits)
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.zeros(a.size, np.uint32)
    for n in range(1, max(orders) + 1):
        if a.size < n:
            break
        h = h[: a.size - n + 1] * np.uint32(0x01000193) + a[n - 1 :] + np.uint32(n)
        if n in orders:
            out += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out
