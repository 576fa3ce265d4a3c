"""Words and shingles of many texts as 64-bit hashes, by numpy over one byte buffer."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lower-cased, and where each text's begin
    (one more place than texts). A word's hash is a polynomial of its bytes, and its length, well mixed."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    blank = np.concatenate(([True], _SPACE[data], [True]))
    starts = np.flatnonzero(blank[:-2] & ~blank[1:-1])
    ends = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return h, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's different ``size``-word shingles; all words as one where they are fewer."""
    h, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled = mixed(rolled + h[j : j + len(rolled)] * np.uint64(2 * j + 3))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mixed(one * np.uint64(5) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
