"""Anchors of byte windows: for each window of ``length`` bytes, its least-hashed q-gram. Equal windows have equal anchors."""

from __future__ import annotations

import numpy as np

from ._shingles import mix

LENGTH = 100
Q = 32
_RNG = np.random.default_rng(99)
_TABLES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of texts that are worked on together. A block must stay under 2^24 bytes; longer texts are cut with an overlap.
BLOCK = 1 << 18
LONGEST = 1 << 22
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, BLOCK + 1), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base][:n]


class Sums:
    """Prefix sums from which the hash of any run of bytes follows."""

    def __init__(self, raw: np.ndarray, kind: int):
        up = _power(_BASES[kind], raw.size + 1)
        self.down = _power(pow(_BASES[kind], -1, 2**64), raw.size + 1)
        self.sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(_TABLES[kind][raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self.down[:n])


def anchors(raw: np.ndarray, bounds: np.ndarray, sums: Sums, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """(text, first, last, hash): runs of window starts with one anchor, over texts laid end to end at ``bounds``.

    A run belongs to the windows that start at first .. last in the block; hash is that of the anchor's q-gram
    together with its distance from the first window.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if raw.size < length:
        return none
    grams = sums.grams(q)
    low = (grams & ~_PLACE) | np.arange(grams.size, dtype=np.uint64)
    width, span = length - q + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    low = np.minimum(low[: low.size - rest], low[rest:]) if rest else low
    place = (low & _PLACE).astype(np.int64)  # of each window's anchor
    sizes = np.diff(bounds)
    fits = np.flatnonzero(sizes >= length)
    inside = np.zeros(raw.size + 1, np.int32)
    inside[bounds[fits]] += 1
    inside[bounds[fits + 1] - length + 1] -= 1
    valid = np.flatnonzero(np.cumsum(inside[: place.size]) > 0)
    if not valid.size:
        return none
    at = place[valid]
    new = np.ones(valid.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    begin = np.flatnonzero(new)
    first, anchor = valid[begin], at[begin]
    last = valid[np.append(begin[1:], valid.size) - 1]
    text = np.searchsorted(bounds, first, side="right") - 1
    return text, first, last, grams[anchor], anchor
