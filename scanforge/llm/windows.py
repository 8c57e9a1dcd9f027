"""Anchors and hashes of byte windows, for the radix passes of suffix-array deduplication."""

from __future__ import annotations

import numpy as np

POSITION_BITS = 19
SEGMENT = 1 << POSITION_BITS
_TABLE = np.random.default_rng(20240917).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(SEGMENT + 1, b) for b in _BASE]
_INVERSES = [_powers(SEGMENT + 1, pow(b, -1, 2**64)) for b in _BASE]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any substrings of one buffer of at most SEGMENT bytes, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        self.inverse = _INVERSES[which]
        self.prefix = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_TABLE[which][data] * _POWERS[which][: data.size], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        n = self.prefix.size - length
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])


def minimum_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every run of `width` values, the leftmost of equal ones (45 bits are compared)."""
    n = h.size - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low_bits = np.uint64(SEGMENT - 1)
    key = (h & ~low_bits) | np.arange(h.size, dtype=np.uint64)
    rows = np.concatenate([key, np.full(-h.size % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low_bits).astype(np.int64)


def pieces(texts: list[bytes], window: int):
    """(buffer, document index, offset in the document, offset in the buffer, starts) for parts of texts.

    A part holds `starts` window starts and the window - 1 bytes after them; longer texts fall into several parts, so that
    every start of every text lies in exactly one. Texts shorter than a window have none. Buffers are at most SEGMENT bytes.
    """
    most = SEGMENT - window + 1
    held, size = [], 0
    for d, t in enumerate(texts):
        left, at = len(t) - window + 1, 0
        while left > 0:
            take = min(left, most)
            if size + take + window - 1 > SEGMENT:
                yield _joined(texts, held, window)
                held, size = [], 0
            held.append((d, at, size, take))
            size += take + window - 1
            at += take
            left -= take
    if held:
        yield _joined(texts, held, window)


def _joined(texts, held, window):
    data = np.frombuffer(b"".join(texts[d][at : at + take + window - 1] for d, at, _, take in held), np.uint8)
    return (data, *np.array(held, np.int64).T)


def anchors(data: np.ndarray, doc: np.ndarray, at: np.ndarray, base: np.ndarray, take: np.ndarray, window: int, gram: int):
    """Runs of window starts that share an anchor: (gram hash, context hash, document, first start, last start, anchor).

    The anchor of a window is its leftmost gram of smallest hash, which depends on the window's bytes alone: equal windows
    have equal grams at equal offsets. The context is everything from the first start to the end of the last window.
    """
    one, two = Rolling(data, 0), Rolling(data, 1)
    place = minimum_places(one.every(gram), window - gram + 1)
    part = np.repeat(np.arange(base.size), take)
    starts = np.arange(part.size) - np.repeat(np.cumsum(take) - take, take) + base[part]
    place = place[starts]
    edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[edge[1:], place.size] - 1
    p, lo, hi, own = place[edge], starts[edge], starts[last], part[edge]
    grams = one.of(p, p + gram) ^ np.uint64(1)
    context = mix(two.of(lo, hi + window) + mix(((p - lo) * 4096 + (hi - lo)).astype(np.uint64)))
    shift = at[own] - base[own]
    return grams.view(np.int64), context.view(np.int64), doc[own], lo + shift, hi + shift, p + shift
