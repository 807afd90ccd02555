"""Hashes of words and word shingles of whole texts, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_LETTERS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in the bytes of a text."""
    space = np.ones(raw.size + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z counted as a-z: sums of letters times powers, moved to the word's start."""
    up, down = _power(raw.size + 1)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * up[: raw.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; of fewer words, one of all; of none, none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += words[k : k + n] * _PLACES[k % 64]
    return mix(out)


def hashes_of(text: str | None, width: int) -> np.ndarray:
    """Hashes of all shingles of a text, in order, repeats included."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint64)
    return shingle_hashes(word_hashes(raw, *word_bounds(raw)), width)
