"""Runs of repeating words against every pair of words."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaledger.llm import catalogue, periodic_runs
from taxaledger.llm.diagonals import runs


def plain_runs(words):
    """Every lag on its own; a stretch counts if no smaller period fits it."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k - p] for k in range(s + p, s + length)) for p in range(1, q)):
                found.append((s, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def several(lists):
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.array([w for x in lists for w in x], np.int64)
    got = [[] for _ in lists]
    firsts = np.cumsum([0] + [len(x) for x in lists])
    for s, length, q in runs(flat, text).tolist():
        got[text[s]].append((s - firsts[text[s]], length, q))
    return got


def repeats(rng, kinds, n):
    out = []
    while len(out) < n:
        unit = [rng.randrange(kinds) for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
        out += (unit * rng.randrange(1, 6))[: rng.randrange(1, 200)] if rng.random() < 0.8 else [rng.randrange(kinds)] * rng.randrange(1, 40)
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_built_texts(seed):
    rng = random.Random(seed)
    lists = [repeats(rng, rng.choice([1, 2, 3, 50]), rng.randrange(0, 350)) for _ in range(6)]
    assert several(lists) == [plain_runs(x) for x in lists]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 8)), max_size=6))
def test_runs_of_any_words(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert several([words, words[::-1]]) == [plain_runs(words), plain_runs(words[::-1])]


def test_one_word_and_one_line_very_often():
    """No pairs of all occurrences: 400,000 equal words would be 80 billion."""
    n = 400_000
    assert runs(np.zeros(n, np.int64), np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    line = np.tile(np.arange(37), 9000)
    assert runs(line, np.zeros(len(line), np.int64)).tolist() == [[0, len(line), 37]]
    assert runs(np.repeat(np.tile([0, 1], 4000), 30), np.zeros(240_000, np.int64))[:, 2].max() == 60


def cases():
    rng = random.Random(9)
    words = ["a", "b", "Ä", "日本", "x\x1cy", "z z", "\u0085"]
    said = lambda n, k: " ".join(str(x) if x >= len(words) else words[x] for x in repeats(rng, k, n))
    rows = [(i, said(rng.randrange(0, 260), rng.choice([1, 3, 60]))) for i in range(120)]
    rows += [(5, None), (None, None), (6, ""), (7, " \t\n"), (8, "word"), (None, "a b c " * 12), (9, "a\tb\nc\x0bd\x0ce\rf " * 9), (9, "a b " * 11 + "a b"), rows[3], rows[3]]
    return rows


def test_rows_against_plain(llm, none):
    rows = cases()
    df = llm.createDataFrame([(i, t, 1, "x", 2, None) for i, t in rows], "doc_id long, text string, start long, runs string, n_words long, collapsed string").repartition(4)
    got = [tuple(r) for r in periodic_runs.digests(periodic_runs.periodic_runs(df, order=periodic_runs.planted_order)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert periodic_runs.digests(periodic_runs.periodic_runs(none)).count() == 0


def test_runs_and_texts_come_back(llm):
    df = llm.createDataFrame([(1, "so  it goes " + "on and " * 15 + "on\nend")], "doc_id long, text string")
    r = periodic_runs.periodic_runs(df).first()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (35, [(3, 31, 2)], "so it goes on and end")


def test_a_text_beyond_the_slice(llm):
    """3 MB, longer than a slice: runs at both ends and one over the middle."""
    rng = random.Random(2)
    words = [str(rng.randrange(10**6)) for _ in range(400_000)]
    words[:30] = ["x", "y"] * 15
    words[180_000:230_000] = (words[180_000:180_900] * 60)[:50_000]
    words[-27:] = ["q", "r", "s"] * 9
    df = llm.createDataFrame([(1, " ".join(words)), (2, "x")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {1: [(0, 30, 2), (180_000, 50_000, 900), (399_973, 27, 3)], 2: []}


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query_against_sql(llm, scale):
    name, folder = "op11_periodic_runs", f"/root/testdata/{scale}"
    con = duck(folder)
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert difference(catalogue.QUERIES[name](llm, folder), con, catalogue.SQL[name]) is None
