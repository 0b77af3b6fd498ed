"""64-bit fingerprints of words and shingles of whole texts, in numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's fingerprint is a polynomial of its bytes
modulo 2^64, taken from running sums and mixed; equal words have equal fingerprints in every process, and different ones
collide with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
#: Bytes hashed at once; longer texts are cut at white space, a longer word is hashed alone.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_part(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(len(b))
    run = np.concatenate([[np.uint64(0)], np.cumsum(_LOWER[b] * up[:len(b)], dtype=np.uint64)])
    h = (run[end] - run[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None) -> np.ndarray:
    """Fingerprints of a text's words, in order."""
    data = (text or "").encode()
    if len(data) <= CHUNK:
        return _hash_part(np.frombuffer(data, dtype=np.uint8))
    b = np.frombuffer(data, dtype=np.uint8)
    space, parts, at = np.flatnonzero(_SPACE[b]), [], 0
    while at < len(b):
        k = int(np.searchsorted(space, at + CHUNK, side="right")) - 1
        cut = int(space[k]) if k >= 0 and space[k] > at else int(space[k + 1]) if k + 1 < len(space) else len(b)
        cut = max(cut, at + 1)
        parts.append(_hash_part(b[at:cut]))
        at = cut
    return np.concatenate(parts)


def chained(*columns: np.ndarray) -> np.ndarray:
    """One fingerprint of several, by position."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + c)
    return h


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of ``size`` consecutive words; of fewer, but not none, the whole sequence is one."""
    if not len(words):
        return words
    if len(words) < size:
        return chained(*(words[k:k + 1] for k in range(len(words))))
    return np.unique(chained(*(words[k:len(words) - size + 1 + k] for k in range(size))))
