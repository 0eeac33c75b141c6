"""A masked-word network over a window on both sides, in numpy.

Each position's embedding of the words two before, one before, one after and
two after adds up to a hidden state, which predicts the masked word in between:
first its class, then its place in the class, so that a word costs two small
softmaxes. Training is AdaGrad on the exact gradient.
"""

from __future__ import annotations

import numpy as np

VOCAB = 1024
CLASSES = 32
PLACES = VOCAB // CLASSES
UNITS = 32
OFFSETS = (-2, -1, 1, 2)
BATCH = 8192
RATE = 0.08
#: Rows of one word in a batch from which on they are summed on their own.
OFTEN = 32

SHAPES = {"near": (len(OFFSETS), VOCAB, UNITS), "hidden_bias": (UNITS,), "cls": (UNITS, CLASSES), "cls_bias": (CLASSES,), "place": (CLASSES, UNITS, PLACES), "place_bias": (CLASSES, PLACES)}

Weights = dict[str, np.ndarray]


def initial(seed: int = 3) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k.endswith("bias") else rng.normal(0, 0.1, s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES]).astype(np.float64)


def unflat(x: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def contexts(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """len(OFFSETS) x n words around each word of its text; 0 beyond the text's ends."""
    out = np.zeros((len(OFFSETS), len(ids)), np.int64)
    for row, o in zip(out, OFFSETS, strict=True):
        a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        row[a] = np.where(doc[a] == doc[b], ids[b], 0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= 1 / x.sum(axis=0)
    return x


def _log_picked(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The log-softmax over the first axis, of one row in each column."""
    x -= x.max(axis=0)
    picked = x[row, np.arange(x.shape[1])]
    return picked - np.log(np.exp(x, out=x).sum(axis=0))


def _sorted_order(x: np.ndarray) -> np.ndarray:
    """Stable order of word or class numbers; numpy sorts 16 bits by radix."""
    return np.argsort(x.astype(np.uint16), kind="stable")


def _hidden(w: Weights, near: np.ndarray) -> np.ndarray:
    h = w["near"][0].take(near[0], axis=0)
    for p in range(1, len(OFFSETS)):
        h += w["near"][p].take(near[p], axis=0)
    h += w["hidden_bias"]
    return np.tanh(h, out=h)


def log_probabilities(w: Weights, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of each word given the words around it."""
    out = np.empty(len(ids))
    for b in range(0, len(ids), BATCH):
        t = ids[b : b + BATCH]
        order = _sorted_order(t // PLACES)
        h, t = _hidden(w, near[:, b : b + BATCH]).take(order, axis=0), t[order]
        cls = t // PLACES
        got = _log_picked(w["cls"].T @ h.T + w["cls_bias"][:, None], cls)
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            i, j = ends[c], ends[c + 1]
            if i < j:
                got[i:j] += _log_picked(w["place"][c].T @ h[i:j].T + w["place_bias"][c][:, None], t[i:j] % PLACES)
        out[b + order] = got
    return out


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What ``np.add.reduceat`` gives along the first axis, in whole rows at a time.

    Runs of ``OFTEN`` rows or more are summed one by one, all others together:
    their first rows, then their second ones, the longest runs first.
    """
    counts = np.diff(np.append(starts, len(rows)))
    rank = np.argsort(-counts, kind="stable")
    first, counts = starts[rank], counts[rank]
    sums = rows.take(first, axis=0)
    often = int(np.searchsorted(-counts, -OFTEN, side="right"))
    for k in range(often):
        sums[k] = rows[first[k] : first[k] + counts[k]].sum(0)
    longer = len(counts) - np.cumsum(np.bincount(counts[often:], minlength=1)) - often
    for r in range(1, len(longer) - 1):
        most = often + longer[r]
        sums[often:most] += rows.take(first[often:most] + r, axis=0)
    out = np.empty_like(sums)
    out[rank] = sums
    return out


def _by_neighbour(ids: np.ndarray, near: np.ndarray, at: int, d_h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums of ``d_h`` by offset and the word there, over the places from ``at`` on: offsets x VOCAB x units.

    ``place`` is the row of ``d_h`` of each place; a row of zeros follows the
    last. What the places around a word add to it lies in one row, an offset
    after the other, so one pass over the words in order sums all offsets.
    """
    n, reach = near.shape[1], max(abs(o) for o in OFFSETS)
    first, last = max(0, at - reach), min(len(ids), at + n + reach)
    of = np.full((last - first, len(OFFSETS)), n)
    out = np.zeros(SHAPES["near"], np.float32)
    for p, o in enumerate(OFFSETS):
        shift = at + o - first
        i, j = max(0, -shift), min(n, len(of) - shift)
        beyond = near[p] == 0
        of[i + shift : j + shift, p] = np.where(beyond[i:j], n, place[i:j])
        out[p, 0] = d_h.take(place[beyond], axis=0).sum(0)
    words = ids[first:last]
    by = _sorted_order(words)
    words = words[by]
    starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    sums = _sums(d_h.take(of[by].ravel(), axis=0).reshape(len(of), -1), starts)
    out[:, words[starts]] = sums.reshape(-1, len(OFFSETS), UNITS).transpose(1, 0, 2)
    return out


class Trainer:
    """AdaGrad from given weights."""

    def __init__(self, w: Weights):
        self.w = {k: x.copy() for k, x in w.items()}
        self.squares = {k: np.full_like(x, 1e-4) for k, x in w.items()}
        self.seen = 0

    def learn(self, ids: np.ndarray, near: np.ndarray) -> None:
        """``near`` are the ``contexts`` of ``ids``."""
        for b in range(0, len(ids), BATCH):
            self._step(ids, near[:, b : b + BATCH], b)

    def _step(self, ids: np.ndarray, near: np.ndarray, at: int) -> None:
        w, n = self.w, near.shape[1]
        t = ids[at : at + n]
        order = _sorted_order(t // PLACES)
        t, h = t[order], _hidden(w, near).take(order, axis=0)  # words x units
        cls = t // PLACES
        d = _softmax(w["cls"].T @ h.T + w["cls_bias"][:, None])
        d[cls, np.arange(n)] -= 1
        g = {"cls": h.T @ d.T, "cls_bias": d.sum(1), "place": np.zeros_like(w["place"]), "place_bias": np.zeros_like(w["place_bias"])}
        d_h = np.zeros((n + 1, UNITS), np.float32)
        np.matmul(d.T, w["cls"].T, out=d_h[:n])
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            i, j = ends[c], ends[c + 1]
            if i < j:
                e = _softmax(w["place"][c].T @ h[i:j].T + w["place_bias"][c][:, None])
                e[t[i:j] % PLACES, np.arange(j - i)] -= 1
                g["place"][c], g["place_bias"][c] = h[i:j].T @ e.T, e.sum(1)
                d_h[i:j] += e.T @ w["place"][c].T
        h *= h
        d_h[:n] *= np.subtract(1, h, out=h)
        place = np.empty_like(order)
        place[order] = np.arange(n)
        g["hidden_bias"], g["near"] = d_h.sum(0), _by_neighbour(ids, near, at, d_h, place)
        for k, x in g.items():
            x /= n
            self.squares[k] += x * x
            w[k] -= RATE * x / np.sqrt(self.squares[k])
        self.seen += n
