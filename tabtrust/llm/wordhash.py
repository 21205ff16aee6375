"""Hashes of words and of word sequences, vectorised over the bytes of many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed together in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20240607)
#: A random value for each byte, and powers of an odd base for its place in the word.
VALUE = _RNG.integers(0, 2**64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
ROLL = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    global _POWERS
    if base == BASE and len(_POWERS) >= n:
        return _POWERS[:n]
    out = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096) - 1, base, np.uint64)], dtype=np.uint64)
    if base == BASE:
        _POWERS = out
    return out[:n]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of bytes that are no ASCII white space."""
    a = np.frombuffer(data, np.uint8)
    inside = ~SPACE[a]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    n = ends - starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, n)
    value = VALUE[a[at]] * powers(int(n.max()))[place]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    return mix(np.add.reduceat(value, first) + n.astype(np.uint64)), starts, ends


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, word hashes, text of each word) of runs of texts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_BYTES):
            size += len(texts[j]) + 1
            j += 1
        h, starts, _ = words(b" ".join(texts[i:j]))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield i, j - i, h, np.searchsorted(ends, starts, side="right")
        i = j


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, as long as there are n."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * ROLL + h[k : len(h) - n + 1 + k]
    return mix(out + np.uint64(n))
