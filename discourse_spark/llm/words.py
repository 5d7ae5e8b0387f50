"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials over
random 64-bit values of the bytes, followed by a mixing step.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 3
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (_running_powers(b, size) for b in (BASE, inverse))
        return self.up[:n], self.down[:n]

    def __reduce__(self):  # a function that uses them doesn't carry the tables along
        return _Powers, ()


def _running_powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """The last step of a common 64-bit mixer."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                byte_values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each byte span of a uint8 array."""
    up, down = _POWERS.upto(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(byte_values[buffer] * up[: len(buffer)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(buffer: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buffer) + 2, dtype=bool)
    inside[1:-1] = ~space[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def batches(texts: list[bytes], most: int = 1 << 20):
    """Ranges of texts with about ``most`` bytes together; a longer text is alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes], space: np.ndarray = SPACE):
    """Hashes of all words of the texts, and where each text's words begin.

    Returns (hashes, bounds, buffer, starts, ends); text i has the words
    ``bounds[i]:bounds[i + 1]``.
    """
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = word_spans(buffer, space)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_starts = np.concatenate(([0], np.cumsum(lengths)))
    bounds = np.searchsorted(starts, text_starts)
    bounds[-1] = len(starts)
    return span_hashes(buffer, starts, ends), bounds, buffer, starts, ends


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, width: int):
    """Hashes of all runs of ``width`` words, text by text.

    Returns (shingles, bounds). A text with fewer words has none here.
    """
    n = len(hashes) - width + 1
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    shingle_bounds = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), shingle_bounds
    combined = hashes[:n].copy()
    for k in range(1, width):
        combined *= np.uint64(BASE)
        combined += hashes[k : n + k]
    inside = np.zeros(n + 1, dtype=np.int8)
    some = counts > 0
    np.add.at(inside, bounds[:-1][some], 1)
    np.add.at(inside, bounds[:-1][some] + counts[some], -1)
    return mix(combined[np.cumsum(inside[:-1]) > 0]), shingle_bounds


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a short word sequence as one unit."""
    h = len(hashes)
    for word in hashes.tolist():
        h = (h * BASE + word) & _MASK
    return mix(np.array([h ^ 0x5DEECE66D], dtype=np.uint64))[0]
