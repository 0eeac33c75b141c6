"""Words of many texts and their 64-bit hashes, as numpy arrays.

Words are runs of digits, letters a-z (A-Z are lowered) and characters beyond
ASCII, taken on the UTF-8 bytes. A word's hash is a polynomial in its bytes
modulo 2**64, read off a running sum, then mixed; equal words have equal hashes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[0x80:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.held = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.held) < n:
            self.held = np.concatenate((self.held, self.held * (self.held[-1:] * self.base)))
        return self.held[:n]


_powers, _inverses = _Powers(_BASE), _Powers(_INVERSE)


class Words:
    """The words of a list of texts, in order.

    ``data``: lowered bytes, a zero byte after each text; ``start``, ``end``: of
    each word in it; ``doc``: number of its text; ``hash``; ``first``: for each
    text the number of its first word, with one more entry at the end.
    """

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        inside = np.concatenate(([False], IS_WORD[self.data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        ends = np.cumsum(lengths + 1)
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(len(self.data)), dtype=np.uint64)))
        raw = (sums[self.end] - sums[self.start]) * _inverses(len(self.data))[self.start] if len(self.start) else np.zeros(0, np.uint64)
        self.hash = mixed(raw)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k words in a row, for each first word but the last k-1 of the list."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _BASE + self.hash[j : j + n]
        return mixed(out + np.uint64(k))

    def joined(self, a: int, b: int) -> str:
        """Words a to b (exclusive), by a space."""
        return " ".join(self.data[s:e].tobytes().decode() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))
