"""Links between the bags of one cell, in numpy.

A bag is the sorted array of its shingle hashes, a shingle of count c being c
different hashes (see ``unary``). So the sum of minima of two bags is the number
of hashes they share, and the sum of maxima what is left of both.
"""

from __future__ import annotations

import numpy as np

from taxaledger.llm.word_hashes import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Pairs of a cell up to which each is intersected on its own.
FEW_PAIRS = 64
#: Bags that share a hash up to which their pairs are counted one by one.
FEW_BAGS = 16
#: Columns of the products that count the other hashes.
COLUMNS = 4096


def unary(doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash), by text and hash: the n-th copy of a shingle has a hash of its own."""
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    doc, h = np.repeat(doc, count), np.repeat(h, count)
    h = np.where(copy > 0, mixed(h + copy.astype(np.uint64) * _STEP), h)
    order = np.lexsort((h, doc))
    return doc[order], h[order]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two bags share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def overlaps(bags: list[np.ndarray], n_left: int) -> np.ndarray:
    """Shared hashes of each left bag with each right one; without left bags, of all with all."""
    n = len(bags)
    rows, first = (n_left, n_left) if n_left else (n, 0)
    out = np.zeros((rows, n - first))
    h, owner = np.concatenate(bags), np.repeat(np.arange(n), [len(b) for b in bags])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    held = np.diff(np.concatenate((begin, [len(h)])))
    for size in range(2, FEW_BAGS + 1):
        at = begin[held == size]
        if not len(at):
            continue
        posted = owner[at[:, None] + np.arange(size)]
        for i, j in zip(*np.triu_indices(size, 1), strict=True):
            a, b = posted[:, i], posted[:, j]
            if n_left:
                across = (a < n_left) & (b >= n_left)
                a, b = a[across], b[across]
            np.add.at(out, (a, b - first), 1)
    if not n_left:
        out += out.T
    many = np.flatnonzero(held > FEW_BAGS)
    for c in range(0, len(many), COLUMNS):
        part = many[c : c + COLUMNS]
        width = held[part]
        column = np.repeat(np.arange(len(part)), width)
        at = np.repeat(begin[part], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        holds = np.zeros((n, len(part)), np.float32)
        holds[owner[at], column] = 1
        out += holds[:rows] @ holds[first:].T
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as one link from each label but the smallest of its component to that one."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if (new == label).all():
            own = label != np.arange(len(names))
            return names[label[own]], names[own]
        label = new


def links(bags: list[np.ndarray], comps: np.ndarray, n_left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The components that pairs of similarity ``threshold`` or more join.

    The first ``n_left`` bags meet the others; without any, all meet all.
    """
    n = len(bags)
    sizes = np.array([len(b) for b in bags])
    pairs = n_left * (n - n_left) if n_left else n * (n - 1) // 2
    if pairs <= FEW_PAIRS or n_left == 1:
        found = []
        for i in range(n_left or n):
            for j in range(n_left or i + 1, n):
                if comps[i] != comps[j] and min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) * (1 - 1e-9):
                    both = shared(bags[i], bags[j])
                    if both / (sizes[i] + sizes[j] - both) >= threshold:
                        found.append((i, j))
        i, j = np.array(found, np.int64).reshape(-1, 2).T
    else:
        both = overlaps(bags, n_left)
        rows, first = (n_left, n_left) if n_left else (n, 0)
        near = both / (sizes[:rows, None] + sizes[None, first:] - both) >= threshold
        near &= comps[:rows, None] != comps[None, first:]
        i, j = np.nonzero(near)
        j = j + first
    return forest(comps[i], comps[j])
