"""Hashes of the words of a text and of their shingles, computed on whole byte arrays."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # bytes hashed at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
RADIX = 0xD1342543DE82EF95


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """64-bit hashes of the words between separator bytes; upper and lower case A-Z are the same.

    A word's hash is a polynomial in its bytes, taken from running sums, and mixed.
    """

    def __init__(self, separators: bytes):
        fold = np.arange(256, dtype=np.uint64)
        fold[ord("A") : ord("Z") + 1] += 32
        self.value = mixed((fold + np.uint64(1)) * MIX)
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.value[self.separator] = 0
        self.grow(PIECE)

    def grow(self, n: int) -> None:
        self.power, self.inverse = _powers(RADIX, n), _powers(pow(RADIX, -1, 1 << 64), n)

    def __call__(self, data: bytes) -> np.ndarray:
        a = np.frombuffer(data, np.uint8)
        if len(a) <= PIECE:
            return self._piece(a)
        parts, start, size = [], 0, PIECE
        while start < len(a):
            end = min(start + size, len(a))
            if end < len(a):
                breaks = np.flatnonzero(self.separator[a[start:end]])
                if not len(breaks):  # one word fills the piece
                    size *= 2
                    continue
                end = start + int(breaks[-1]) + 1
            parts.append(self._piece(a[start:end]))
            start, size = end, PIECE
        return np.concatenate(parts)

    def _piece(self, a: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, np.uint64)
        if len(a) > len(self.power):
            self.grow(len(a))
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~self.separator[a]
        edges = np.flatnonzero(np.diff(inside))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.value[a] * self.power[: len(a)], out=sums[1:])
        starts = edges[::2]
        words = mixed((sums[edges[1::2]] - sums[starts]) * self.inverse[starts])
        if len(self.power) > PIECE:
            self.grow(PIECE)
        return words


def shingles(words: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all runs of ``span`` words, in order."""
    h = np.full(max(0, len(words) - span + 1), span, np.uint64)
    for i in range(span):
        h = h * MIX + words[i : i + len(h)]
    return mixed(h)
