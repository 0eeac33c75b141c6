"""BagMinHash: weighted-Jaccard signatures of bags of word shingles, in numpy.

Each (shingle, weight) drives Poisson processes in time. Its weight axis is
discretised into dyadic intervals [0,1), [1,2), [2,4), ...; the points of an
interval come from the shingle's hash and the interval alone, so bags of other
weights share them, and a point counts for a bag if its place on the weight
axis lies below the bag's weight. Each point also picks one component of the
signature, which keeps the earliest point it gets. Two bags keep the same point
in a component with a probability of their weighted Jaccard similarity. A weight
costs its logarithm, and points are made only up to the time by which all
components are likely filled (twice that for the bags where one is not).
"""

from __future__ import annotations

import numpy as np

from taxaledger.llm.word_hashes import Words, mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _times(n: int, c: np.uint64) -> np.uint64:
    return np.uint64(n * int(c) & 0xFFFFFFFFFFFFFFFF)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct k-word shingles, by text and hash.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    grams = words.grams(k)
    whole = words.doc[: len(grams)] == words.doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    docs, hashes = [words.doc[: len(grams)][whole]], [grams[whole]]
    counts = words.counts()
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            docs.append(short)
            hashes.append(words.grams(n)[words.first[short]])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def _points(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, until: np.ndarray, m: int):
    """(cell, time, point) of all points up to each bag's time."""
    out, level = [], 0
    while True:
        lower, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        has = weight > lower
        if not has.any():
            break
        d, w, seed = doc[has], weight[has], mixed(h[has] + _times(level + 1, _OTHER))
        time, limit, n = np.zeros(len(d)), until[d], 0
        while len(d):
            r = mixed(seed + _times(n, _STEP))
            time = time - np.log(((r >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / (m * width)
            on = time <= limit
            d, w, seed, time, limit, r = d[on], w[on], seed[on], time[on], limit[on], r[on]
            point = mixed(r ^ _OTHER)
            below = lower + (point & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width < w
            component = ((point >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            out.append(((d * m + component)[below], time[below], point[below]))
            n += 1
        level += 1
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m components; zero for texts without shingles."""
    out = np.zeros(n_docs * m, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    todo, factor = total > 0, 1.0
    while todo.any():
        mine = todo[doc]
        until = np.where(todo, factor * (np.log(m) + 3) / np.maximum(total, 1), 0)
        cell, time, point = _points(doc[mine], h[mine], weight[mine], until, m)
        best = np.full(n_docs * m, np.inf)
        np.minimum.at(best, cell, time)
        first = time == best[cell]
        out[cell[first]] = point[first]
        todo &= np.isinf(best.reshape(n_docs, m)).any(axis=1)
        factor *= 2
    return out.reshape(n_docs, m)


def bands(signature: np.ndarray, n_bands: int) -> np.ndarray:
    """n_docs x n_bands hashes, each of a run of components and its number."""
    rows = signature.shape[1] // n_bands
    out = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        out = out * _STEP + signature[:, r::rows][:, :n_bands]
    return mixed(out).view(np.int64)
