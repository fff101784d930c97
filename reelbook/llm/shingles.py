"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

_U = np.uint64
#: Bytes hashed at once; a chunk ends at white space, or goes on to the end of a longer word.
_CHUNK = 1 << 18
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number per byte; which bytes are white space (fixed: 9 to 13 and 32)."""
    letters = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
    space = np.zeros(256, bool)
    space[[*range(9, 14), 32]] = True
    return letters, space


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK + 1)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _chunk_words(data: np.ndarray) -> np.ndarray:
    letters, space = _tables()
    blank = space[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word in order: runs of other bytes than white space, A-Z lowered."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(data) <= _CHUNK:
        return _chunk_words(data)
    space, parts, at = _tables()[1], [], 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data):
            found = np.flatnonzero(space[data[end : end + _CHUNK]])
            if len(found):
                end += int(found[0])
                break
            end += _CHUNK
        parts.append(_chunk_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of fewer words the whole text is one; of none, nothing."""
    hashes = word_hashes(text)
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, words)
    sums = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        sums = mix(sums * _U(_BASE) + hashes[k : n - size + 1 + k])
    return np.unique(sums)
