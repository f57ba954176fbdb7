"""Hashed word shingles of texts, vectorised over a slice of documents."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SHORT = np.uint64(0x8EBC6AF09C88C6E3)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """``BASE**0 ... BASE**(n-1)`` modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words start (one more entry than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    lengths = np.flatnonzero(edge == -1) - starts
    where = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(where)) - np.repeat(first, lengths)
    values = (data[where].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z.

    A text with fewer than ``size`` words has one shingle, its whole word sequence; one
    without words has none.
    """
    words, at = word_hashes([t.lower() for t in texts])
    odd = _ODD[np.arange(size) % len(_ODD)] + np.uint64(2) * (np.arange(size) // len(_ODD)).astype(np.uint64)
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        full += words[j : j + len(full)] * odd[j]
    full = mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            k = b - a
            out.append(mix((words[a:b] * odd[:k]).sum(dtype=np.uint64, keepdims=True) + np.full(1, _SHORT) * np.full(1, k, np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """``bands * rows`` universal hash minima ``(a * x + b) mod 2**32`` over the top halves of shingle hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 8):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]
        self.weights = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def minima(self, keys: np.ndarray, block: int = 1024) -> np.ndarray:
        x = (keys >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(x), block):
            h = self.a * x[at : at + block]
            h += self.b
            m = h.min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key a band; keys of different bands differ."""
        rows = minima.reshape(self.bands, self.rows).astype(np.uint64)
        return mix((rows * self.weights).sum(axis=1, dtype=np.uint64) + self.names)

    @staticmethod
    def short(minima: np.ndarray) -> bytes:
        """One byte of each minimum: equal minima have equal bytes, others one time in 256."""
        return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()
