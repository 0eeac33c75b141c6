"""BPE merges by a segment tree over adjacent pair ranks, for many pieces at once.

Each leaf holds the rank of the pair that starts there, joined with its place,
so the root is the leftmost pair of the lowest rank. A merge changes at most
three leaves, and each change walks to the root in a logarithmic number of
steps. A piece is done when its root is empty: no mergeable pair remains.

The pieces of a batch are rows of one array: every round merges the root's pair
of each unfinished row, with numpy in place of a loop over rows.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 62

#: Cells of trees that a batch may hold.
CELLS = 1 << 21


class PairRanks:
    """Open-addressing map from an id pair to its merge rank, looked up by array."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int64)
        keys = left.astype(np.int64) << 24 | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # the first of equal slots takes it, the others move on
            free = self.key[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.key[at[first]], self.rank[at[first]] = keys[todo[first]], todo[first]
            kept = np.ones(len(todo), bool)
            kept[first] = False
            todo, at = todo[kept], (at[kept] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 for pairs that never merge."""
        keys = left << 24 | right
        at = self._slot(keys)
        held = self.key[at]
        out = np.where(held == keys, self.rank[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class SegmentTreeBpe:
    """The merges of one vocabulary whose words end in a marked letter."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, letters: list[str]):
        self.ranks = PairRanks(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (not empty) pieces, one piece after the other, and the ids of each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        width = 1 << np.ceil(np.log2(np.maximum(2, lengths))).astype(np.int64)
        for w in np.unique(width[lengths > 1]):
            rows = np.flatnonzero((width == w) & (lengths > 1))
            step = max(1, CELLS // int(w))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                place = (ends[r] - lengths[r])[:, None] + np.arange(w)
                inside = np.arange(w) < lengths[r][:, None]
                grid = np.where(inside, ids[np.where(inside, place, 0)], -1)
                self._merge(grid, lengths[r])
                ids[place[inside]] = grid[inside]
        left = ids >= 0
        counts = np.diff(np.concatenate(([0], np.cumsum(left)[ends - 1])))
        return ids[left], counts

    def _merge(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Merge the rows of ``ids`` in place; -1 where nothing is left."""
        n, size = ids.shape
        bits = size.bit_length() - 1
        tree = np.full((n, 2 * size), NONE)
        pair = np.nonzero(np.arange(size - 1) < lengths[:, None] - 1)
        tree[pair[0], size + pair[1]] = self._leaf(ids[pair], ids[pair[0], pair[1] + 1], pair[1], bits)
        at = size
        while at > 1:
            np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2], out=tree[:, at // 2 : at])
            at //= 2
        flat, flat_ids = tree.reshape(-1), ids.reshape(-1)
        after = np.tile(np.arange(1, size + 1, dtype=np.int64), (n, 1)).reshape(-1)
        before = np.tile(np.arange(-1, size - 1, dtype=np.int64), (n, 1)).reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            base, root = rows * size, flat[rows * 2 * size + 1]
            i = root & (size - 1)
            new = self.made[root >> bits]
            j = after[base + i]
            k = after[base + j]
            h = before[base + i]
            flat_ids[base + i], flat_ids[base + j] = new, -1
            after[base + i] = k
            has_k, has_h = k < lengths[rows], h >= 0
            before[(base + k)[has_k]] = i[has_k]
            leaf_i, leaf_h = np.full(len(rows), NONE), np.full(len(rows), NONE)
            leaf_i[has_k] = self._leaf(new[has_k], flat_ids[(base + k)[has_k]], i[has_k], bits)
            leaf_h[has_h] = self._leaf(flat_ids[(base + h)[has_h]], new[has_h], h[has_h], bits)
            top = 2 * base
            flat[top + size + j], flat[top + size + i] = NONE, leaf_i
            flat[(top + size + h)[has_h]] = leaf_h[has_h]
            for place in (size + j, size + i, size + np.where(has_h, h, i)):
                for _ in range(bits):
                    place = place >> 1
                    down = top + 2 * place
                    flat[top + place] = np.minimum(flat[down], flat[down + 1])
            rows = rows[flat[top + 1] < NONE]

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank < 0, NONE, rank << bits | place)
