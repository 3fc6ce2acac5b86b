"""Word shingles of texts as 64-bit hashes, whole batches at a time in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (maximal run without ASCII white space, A-Z lowered), in order."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.diff(inside, prepend=False, append=False)
    at = np.flatnonzero(edge)
    first, end = at[0::2], at[1::2]
    # each word's polynomial over its own bytes: prefix sums, shifted back by an inverse power
    powers = _powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    back = _powers(_INVERSE, len(data))[first]
    return mixed((total[end] - total[first]) * back + (end - first).astype(np.uint64))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``width`` words; of all words where there are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(_BASE) + w[i : i + n])
    return np.unique(h)
