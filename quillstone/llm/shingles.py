"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 2 + 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BACK)):
            row = np.full(max(n, 1 << 18), b)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and each text's number of words. A word's hash doesn't depend on its place."""
    joined = b" ".join(texts) + b" "
    b = np.frombuffer(joined.lower(), np.uint8)
    up, down = _power(len(b) + 1)
    space = _SPACE[b]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])])
    h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _PLACE[15])
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(begin, ends, side="left"), prepend=0)
    return h, count


def shingle_sets(texts: list[bytes], k: int = 4) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; with fewer words, the whole as one; without words, none."""
    h, count = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        rolled += h[i : len(h) - k + 1 + i] * _PLACE[i]
    rolled = mix(rolled)
    out, at = [], 0
    for n in count:
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            out.append(mix((h[at : at + n] * _PLACE[5 : 5 + n]).sum(dtype=np.uint64)[None] + np.uint64(n)))
        else:
            out.append(h[:0])
        at += n
    return out
