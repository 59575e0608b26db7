"""Hashed word shingles of many texts at once.

Words are runs between white space. A word's hash is a polynomial over its code points, taken from prefix sums modulo
2**64 and then mixed; a shingle's hash mixes those of its words. A text of fewer words than a shingle has, but of at
least one, has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .common import code_points, mix64

WORDS = 5
_R = 0x9E3779B97F4A7C15 | 1
_MULT = (np.random.default_rng(7).integers(1, 2**63, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


@cache
def _space() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x3100) if chr(i).isspace()]] = True
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if len(_known[0]) < n:
        size = max(n, 2 * len(_known[0]))
        for k, r in enumerate((_R, pow(_R, -1, 2**64))):
            f = np.full(size, r, dtype=np.uint64)
            f[0] = 1
            _known[k] = np.multiply.accumulate(f)
    return _known[0][:n], _known[1][:n]


_known = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the n+1 offsets of the texts in them."""
    return _words(texts)[:2]


def words_and_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` and, for each word, the number of its line, counted over all texts, a text starting with the line in which the one before ends."""
    hashes, offsets, start, points = _words(texts)
    return hashes, offsets, np.searchsorted(np.flatnonzero(points == 10), start)


def _words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    points, ends = code_points([f"{t or ''} " for t in texts])  # the space ends the last word
    inside = ~_space()[points]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = mix64((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(start, ends), start, points


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles (repeats kept) and the n+1 offsets of the texts in them."""
    count = np.diff(offsets)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), made)
    first = np.arange(out_offsets[-1]) - out_offsets[text] + offsets[text]
    length = np.minimum(count[text], k)
    total = np.zeros(len(first), dtype=np.uint64)
    last = len(words) - 1
    for j in range(k):
        total += np.where(j < length, words[np.minimum(first + j, last)] * _MULT[j], np.uint64(0)) if last >= 0 else np.uint64(0)
    return mix64(total + length.astype(np.uint64)), out_offsets


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = shingle_hashes(*word_hashes(texts), k)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)
