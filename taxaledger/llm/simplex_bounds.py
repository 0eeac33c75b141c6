"""Projection of metric points to simplex apexes, and the bounds it gives on their distances.

``n`` pivots span a simplex of ``n - 1`` dimensions. A point is placed as one
more apex over that base: its distances to the pivots fix its ``n - 1`` base
coordinates and its height over the base, whose side is unknown. For two points
the base coordinates and the difference of heights give a lower bound of their
distance, the sum of heights an upper bound. With one more pivot neither bound
gets worse.
"""

from __future__ import annotations

import numpy as np

#: Bounds are widened by this share of the lengths they come from: far more than rounding adds.
SLACK = 1e-6

#: A pivot this close to the span of those before it (as a share of its distance to the first) adds nothing and is left out.
FLAT = 1e-3


def spread_pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Numbers of up to ``most`` points: the first, then the farthest from all chosen, in general position."""
    x = points.astype(np.float64)
    chosen = [0]
    # What is left of each point once the span of the chosen pivots is taken away.
    rest = x - x[0]
    whole = np.linalg.norm(rest, axis=1)
    while len(chosen) < min(most, len(x)):
        heights = np.linalg.norm(rest, axis=1)
        at = int(heights.argmax())
        if heights[at] <= FLAT * max(whole.max(), 1e-300) or heights[at] == 0:
            break
        chosen.append(at)
        space = rest[at] / heights[at]
        rest = rest - np.outer(rest @ space, space)
    return np.array(chosen)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, all against all, a few rows of ``b`` at a time."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        d = a - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Base:
    """The simplex of the pivots. ``corners``: row i holds pivot i's coordinates (lower triangle)."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        n = len(pivots)
        between = np.sqrt(squared(pivots, pivots).astype(np.float64))
        self.corners = np.zeros((n, max(1, n - 1)))
        for i in range(1, n):
            place = self._place(between[i : i + 1, :i], i)[0]
            self.corners[i, : i - 1], self.corners[i, i - 1] = place[:-1], place[-1]

    def _place(self, distances: np.ndarray, n: int) -> np.ndarray:
        """Coordinates over the first ``n`` pivots: ``n - 1`` in the base and the height."""
        out = np.zeros((len(distances), n))
        first = distances[:, 0] ** 2
        for i in range(1, n):
            corner = self.corners[i, :i]
            own = (corner**2).sum()
            # |x|^2 - |x - corner|^2 = 2 x.corner - |corner|^2; all but the last part of x.corner is known.
            dot = (first - distances[:, i] ** 2 + own) / 2 - out[:, : i - 1] @ corner[: i - 1]
            out[:, i - 1] = dot / corner[i - 1]
        out[:, n - 1] = np.sqrt(np.maximum(0, first - (out[:, : n - 1] ** 2).sum(axis=1)))
        return out

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """Apex coordinates of integer points, from their distances to the pivots."""
        return self._place(np.sqrt(squared(points, self.pivots).astype(np.float64)), len(self.pivots))


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the distances of all apexes ``a`` to all apexes ``b``, widened by ``SLACK``."""
    base = (a[:, None, :-1] - b[None, :, :-1]) ** 2
    base = base.sum(axis=2)
    lower = np.sqrt(base + (a[:, None, -1] - b[None, :, -1]) ** 2)
    upper = np.sqrt(base + (a[:, None, -1] + b[None, :, -1]) ** 2)
    wide = SLACK * (np.linalg.norm(a, axis=1)[:, None] + np.linalg.norm(b, axis=1)[None, :] + 1)
    return lower - wide, upper + wide


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, exact squared distance) of each point's nearest centroid, ties to the smaller number; and the exact distances worked out.

    Centroids whose lower bound is above the least upper bound are left out;
    then those above the exact distance to the one that looked nearest.
    """
    lower, upper = bounds(apexes, centroid_apexes)
    guess = upper.argmin(axis=1)
    d = points - centroids[guess]
    first = np.einsum("ij,ij->i", d, d)
    reach = np.minimum(upper.min(axis=1), np.sqrt(first.astype(np.float64)) * (1 + SLACK) + SLACK)
    left = lower <= reach[:, None]
    left[np.arange(len(points)), guess] = False
    best, number = first.copy(), guess.astype(np.int64)
    asked = len(points)
    # Centroid by centroid in rising order: memory is bounded by the points, not by the pairs.
    for c in range(len(centroids)):
        at = np.flatnonzero(left[:, c])
        if not len(at):
            continue
        asked += len(at)
        d = points[at] - centroids[c]
        found = np.einsum("ij,ij->i", d, d)
        won = (found < best[at]) | ((found == best[at]) & (c < number[at]))
        best[at[won]], number[at[won]] = found[won], c
    return number, best, asked
