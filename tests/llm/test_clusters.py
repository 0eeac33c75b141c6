"""Clustering with simplex bounds against plain distances."""

import hashlib

import numpy as np
import pytest
from compare import difference, duck

from taxaledger.llm import catalogue, centroid_clusters
from taxaledger.llm.simplex_bounds import Base, bounds, nearest, spread_pivots, squared


def points(kind, n, rng):
    if kind == "spread":
        return rng.integers(-300, 300, (n, 64))
    if kind == "flat":  # four dimensions bent into 64
        return np.floor(rng.normal(0, 100, (n, 4)) @ rng.normal(0, 1, (4, 64))).astype(np.int64)
    if kind == "line":
        return rng.integers(-50, 50, (n, 1)) * np.ones((1, 64), np.int64)
    return np.full((n, 64), 7)


@pytest.mark.parametrize("kind", ["spread", "flat", "line", "equal"])
def test_bounds_hold(kind):
    rng = np.random.default_rng(3)
    p, c = points(kind, 400, rng), points(kind, 40, rng)
    base = Base(c[spread_pivots(c, 8)])
    exact = np.sqrt(squared(p, c))
    lower, upper = bounds(base.apexes(p), base.apexes(c))
    assert (lower <= exact).all() and (exact <= upper).all()
    if kind == "flat":  # as many pivots as dimensions leave little between the bounds
        assert np.median((upper - lower) / exact) < 0.5
    number, best, asked = nearest(p, base.apexes(p), c, base.apexes(c))
    assert (best == (exact.round(6) ** 2).round().astype(np.int64).min(axis=1)).all()
    assert (number == squared(p, c).argmin(axis=1)).all()
    if kind == "flat":
        assert asked < 0.5 * p.shape[0] * c.shape[0]


def test_ties_go_to_the_smaller_number():
    c = np.array([[0] * 64, [4] * 64, [4] * 64, [8] * 64])
    p = np.array([[2] * 64, [4] * 64, [6] * 64])
    base = Base(c[spread_pivots(c, 8)])
    assert nearest(p, base.apexes(p), c, base.apexes(c))[0].tolist() == [0, 1, 1]


def plain(rows, k=40, rounds=5):
    """The contract word by word, in Python integers."""
    kept = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(place(v)[1], []).append(v)
        for n, vs in members.items():
            centroids[n] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    per = {n: sum(d for _, m, d in found if m == n) for n in {m for _, m, _ in found}}
    return sorted(((i, n, d, per[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


def test_against_plain_rounds_with_odd_rows(llm):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 64).astype(np.float32)]) for i in rng.permutation(90)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, rows[5][1])] + [(1000 + i, [0.25] * 64) for i in range(60)]  # repeated ids, null ids, one hot vector
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [1.0] * 63 + [None]), (2005, [float("nan")] * 64), (2006, [1.0] * 63 + [float("-inf")])]
    df = llm.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster int, distance long, hash string, n long")
    got = sorted((tuple(r) for r in centroid_clusters.digests(df.repartition(5)).collect()), key=repr)
    assert got == plain(rows)


def test_few_none_and_huge_vectors(llm):
    schema = "vec_id long, embedding array<double>"
    assert centroid_clusters.digests(llm.createDataFrame([], schema)).count() == 0
    assert centroid_clusters.digests(llm.createDataFrame([(1, None)], schema)).count() == 0
    three = [(i, [float(i)] * 64) for i in range(3)]
    got = centroid_clusters.digests(llm.createDataFrame(three, schema)).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(0, 0), (1, 0), (2, 0)] and len({r["cluster"] for r in got}) == 3
    huge = centroid_clusters.digests(llm.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], schema)).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in huge) == [(1, 0), (2, 0), (3, 0)]


def test_query_against_sql(llm, folder):
    name = "op12_nsimplex_clusters"
    con = duck(folder)
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert difference(catalogue.QUERIES[name](llm, folder), con, catalogue.SQL[name]) is None
