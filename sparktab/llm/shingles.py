"""Word shingles of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_PIECE = 1 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(part: np.ndarray) -> np.ndarray:
    solid = ~_SPACE[part]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = (_UP, _DOWN) if len(part) <= _PIECE else (_powers(_BASE, len(part)), _powers(_INVERSE, len(part)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[part] + np.uint64(1)) * up[:len(part)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word, A-Z in lower case. A long text is cut at white space, so memory stays bounded."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= _PIECE:
        return _hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # to the end of the word
            end += 1
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of all words if there are fewer; empty without words."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    run = min(width, len(words))
    count = len(words) - run + 1
    h = np.full(count, run, dtype=np.uint64)
    for j in range(run):
        h = mix(h) * np.uint64(_BASE) + words[j:j + count]
    return np.unique(mix(h))
