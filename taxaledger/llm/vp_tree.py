"""A vantage-point tree over one shard of vectors, searched by many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 128
#: Distances that one step holds.
CELLS = 1 << 21


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, by differences: equal vectors are equally far."""
    out = np.empty((len(q), len(x)))
    step = max(1, CELLS // max(1, len(x) * q.shape[1]))
    for i in range(0, len(q), step):
        d = q[i : i + step, None, :] - x[None]
        out[i : i + step] = np.sqrt((d * d).sum(axis=2))
    return out


@dataclass
class Tree:
    """``order``: rows so that a node is a run; ``nodes``: (begin, middle, end, radius,
    vantage row, left node, right node); a leaf has no vantage row (-1)."""

    order: np.ndarray
    nodes: list[tuple]


def build(x: np.ndarray, seed: int = 5) -> Tree:
    rng = np.random.default_rng(seed)
    order, nodes = np.arange(len(x)), []

    todo = [(0, len(x), None)]
    while todo:
        begin, end, place = todo.pop()
        number = len(nodes)
        if place is not None:
            nodes[place[0]][place[1]] = number
        node = [begin, end, end, 0.0, -1, -1, -1]
        nodes.append(node)
        if end - begin <= LEAF:
            continue
        rows = order[begin:end]
        vantage = int(rows[rng.integers(len(rows))])
        d = distances(x[vantage : vantage + 1], x[rows])[0]
        radius = np.median(d)
        inner = d <= radius
        if inner.all():  # many equal distances: put the farthest outside, if any is farther
            radius = np.nextafter(d.max(), -np.inf) if d.max() > d.min() else radius
            inner = d <= radius
            if inner.all():
                continue
        middle = begin + int(inner.sum())
        order[begin:end] = np.concatenate((rows[inner], rows[~inner]))
        node[1:5] = [middle, end, float(radius), vantage]
        todo += [(middle, end, (number, 6)), (begin, middle, (number, 5))]
    return Tree(order, [tuple(n) for n in nodes])


class Search:
    """The ``k`` nearest rows of each query, ties to the smaller id."""

    def __init__(self, tree: Tree, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.tree, self.x, self.ids, self.rows, self.q, self.own, self.factor = tree, x, ids, rows, q, own, factor
        self.best = np.full((len(q), k), np.inf)
        self.best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.looked = 0

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.x):
            everyone = np.arange(len(self.q))
            home = self._descend(everyone)
            for leaf in np.unique(home):
                self._leaf(int(leaf), everyone[home == leaf])
            self._walk(everyone, home)
        return self.best, self.best_id

    def _descend(self, who: np.ndarray) -> np.ndarray:
        """The leaf on whose side of every vantage point each query lies."""
        home, todo = np.zeros(len(who), np.int64), [(0, who)]
        while todo:
            n, active = todo.pop()
            _, _, _, radius, vantage, left, right = self.tree.nodes[n]
            if vantage < 0:
                home[active] = n
                continue
            inside = distances(self.q[active], self.x[vantage : vantage + 1])[:, 0] <= radius
            todo += [(child, part) for child, part in ((left, active[inside]), (right, active[~inside])) if len(part)]
        return home

    def _walk(self, who: np.ndarray, home: np.ndarray) -> None:
        """All other leaves that the triangle inequality leaves open."""
        todo = [(0, who)]
        while todo:
            n, active = todo.pop()
            _, _, _, radius, vantage, left, right = self.tree.nodes[n]
            if vantage < 0:
                self._leaf(n, active[home[active] != n])
                continue
            d = distances(self.q[active], self.x[vantage : vantage + 1])[:, 0]
            reach = self.factor * self.best[active, -1] * (1 + 1e-9)
            todo += [(child, part) for child, part in ((right, active[radius - d <= reach]), (left, active[d - radius <= reach])) if len(part)]

    def _leaf(self, n: int, active: np.ndarray) -> None:
        begin, _, end = self.tree.nodes[n][:3]
        for at in range(begin, end, 4 * LEAF):
            if not len(active):
                return
            rows = self.tree.order[at : min(end, at + 4 * LEAF)]
            self.looked += len(active) * len(rows)
            d = distances(self.q[active], self.x[rows])
            d[self.rows[rows][None, :] == self.own[active][:, None]] = np.inf
            all_d = np.concatenate((self.best[active], d), axis=1)
            all_id = np.concatenate((self.best_id[active], np.broadcast_to(self.ids[rows], d.shape)), axis=1)
            all_id[np.isinf(all_d)] = np.iinfo(np.int64).max
            first = np.lexsort((all_id, all_d), axis=1)[:, : self.best.shape[1]]
            self.best[active] = np.take_along_axis(all_d, first, axis=1)
            self.best_id[active] = np.take_along_axis(all_id, first, axis=1)
