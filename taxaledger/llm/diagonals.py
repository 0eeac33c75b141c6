"""Runs of repeating words, by match lengths along sparse diagonals.

A diagonal is a lag ``q``: its match length at word ``i`` is how many words in a
row, up to ``i``, equal the word ``q`` before them. A maximal stretch of ``m``
matches on lag ``q`` is a stretch of ``m + q`` words with period ``q``.

All earlier occurrences of a word would be too many lags: in one word said
``n`` times there are ``n * n / 2``. A lag is *active* at word ``i`` on scale
``c`` (16, 32, 64, ...) when it is the distance to the nearest earlier place
where the ``c`` words up to ``i`` stand, and lies in (c/2, c] (up to 16 on the
first scale). So each word has at most one active lag a scale, and none on a
scale whose words in a row it does not repeat. Nothing is lost. Let a run
[s, e] have smallest period ``q``, a length of at least ``3 q`` and of 24, and
let ``c`` be the scale of ``q``. Then ``c + q`` words fit into the run, and for
each i from s + q + c - 1 to e the ``c`` words up to ``i`` stand at distance
``q`` in the run. They do not stand at a smaller distance: they hold a whole
period, and a period that equals its own rotation would have a smaller period.
So the lag stays ``q`` up to ``e`` and its match length, which begins at ``c``,
grows by one a word; where it ends, the diagonal ends, so the run is maximal.
The other way round, a diagonal with a smaller period inside never has the
nearest place at its own lag, so what is emitted has its smallest period.
"""

from __future__ import annotations

import numpy as np

#: Least words of a run, and how often its period must fit in.
LEAST, TIMES = 24, 3

#: First scale. A lag up to it must leave room: scale + lag <= max(LEAST, TIMES * lag) for lags over half of it and all smaller ones.
SCALE = 16


def nearest_earlier(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys at rising positions ``at``: (the nearest earlier position of the same key or -1, a number for each key, whether the key stands elsewhere)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    earlier, number = np.full(len(keys), -1, np.int64), np.empty(len(keys), np.int64)
    repeats = np.flatnonzero(same)
    earlier[order[repeats]] = at[order[repeats - 1]]
    number[order] = np.cumsum(~same) - 1
    often = np.zeros(len(keys), bool)
    often[order[repeats]] = often[order[repeats - 1]] = True
    return earlier, number, often


def ended_diagonals(at: np.ndarray, lag: np.ndarray, scale: int) -> np.ndarray:
    """(start, length, period) of the runs whose diagonals, ``scale`` matches long where they begin, end with a sufficient length."""
    if not len(at):
        return np.zeros((0, 3), np.int64)
    begins = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])))
    first = np.flatnonzero(begins)
    last = np.concatenate((first[1:], [len(at)])) - 1
    period = lag[first]
    match = scale + at[last] - at[first]
    length = match + period
    found = np.stack((at[last] - length + 1, length, period), axis=1)
    return found[length >= np.maximum(LEAST, TIMES * period)]


def runs(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of texts laid end to end, by start, then period.

    ``words``: a number for each word; ``text``: the (rising) number of its text.
    """
    n = len(words)
    found = [np.zeros((0, 3), np.int64)]
    if not n:
        return found[0]
    longest = int(np.bincount(text - text[0]).max())
    at, scale, held = np.arange(n), 1, np.full(n, -1, np.int64)
    # The text is part of the key: no words in a row across two texts stand twice.
    earlier, number, often = nearest_earlier(text.astype(np.int64) * (int(words.max()) + 1) + words, at)
    while True:
        if scale >= SCALE:
            lag = at - earlier
            active = (earlier >= 0) & (lag <= scale) & ((lag > scale // 2) | (scale == SCALE))
            found.append(ended_diagonals(at[active], lag[active], scale))
        if longest < LEAST or (scale >= SCALE and TIMES * (scale + 1) > longest):
            break
        # Words in a row that stand once do not become more by getting longer.
        at, number = at[often], number[often]
        held[:] = -1
        held[at] = number
        before = held[np.maximum(at - scale, 0)]
        both = (before >= 0) & (at >= scale)
        at, keys = at[both], number[both] * (int(number.max(initial=0)) + 1) + before[both]
        if not len(at):
            break
        scale *= 2
        earlier, number, often = nearest_earlier(keys, at)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]
