"""Quality rules against a plain version, and the divergence against its definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import difference, duck

from taxaledger.llm import catalogue, quality_rules
from taxaledger.llm.word_measures import Measures, repeated_windows

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + o for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return w, (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def plain_classes(text):
    def of(c):
        if "a" <= c <= "z":
            return 0
        if "A" <= c <= "Z":
            return 1
        if "0" <= c <= "9":
            return 2
        if c in " \t\n\x0b\x0c\r":
            return 3
        if c in ".,;:!?'\"()-":
            return 4
        return 5 if ord(c) < 128 else 6

    got = Counter(map(of, text or ""))
    return [got[i] for i in range(7)]


def plain_js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(*a) if x)
    return math.sqrt(max(0, (part((p, q)) + part((q, p))) / 2))


def plain_rows(rows):
    made = []
    for doc_id, text, lang in rows:
        w, c = plain_counts(text)
        made.append((doc_id, lang, w, c, plain_classes(text), c[0] < 10 or 100 * c[4] > 20 * c[0]))
    refs = {}
    for lang in {m[1] for m in made if m[1] is not None and not m[5]}:
        own = [m for m in made if m[1] == lang and not m[5]]
        words = Counter(x for m in own for x in m[2])
        top = [x for x, _ in sorted(words.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:64]]
        refs[lang] = ([sum(col) for col in zip(*(m[4] for m in own))], top, [words[t] for t in top] + [sum(words.values()) - sum(words[t] for t in top)])
    out = []
    for doc_id, _, w, c, classes, failed in made:
        kept = not failed
        if kept and refs:
            near = []
            for k, top, counts in refs.values():
                mine = Counter(w)
                own = [mine[t] for t in top]
                near.append((sum(classes) < 250 or plain_js(classes, k) <= 0.25) and (len(w) < 100 or plain_js(own + [len(w) - sum(own)], counts) <= 0.37))
            kept = any(near)
        out.append((doc_id, *c, failed, kept))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    de, en = "der die das und nicht mit von zu im ist ein als auf für".split(), "the of and to in is that it for was on with as by".split()
    prose = lambda words, n: " ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, prose(de, rng.randrange(5, 400)), "de") for i in range(30)] + [(100 + i, prose(en, rng.randrange(5, 400)), "en") for i in range(40)]
    rows += [(200 + i, " ".join(x.upper() + "!!" for x in prose(en, 150).split()), "en") for i in range(3)]
    rows += [(300 + i, " ".join(x + "$$$" for x in prose(en, 150).split()), None) for i in range(3)]
    rows += [(400, "一二 三四 " * 200, "xx"), (401, prose(["q"], 130), "en"), (402, None, "en"), (403, "", "de"), (404, " \n\t", None), (None, prose(en, 60), "en"), (None, None, None)]
    rows += [(405, "same line here\n" * 12, "en"), (406, "a b c d e\nx\na b c d e\n \n \nx y z w v u t", None), rows[3], rows[40], (407, "one two three four five six seven eight nine", "en"), (408, "x\x1cy \x85 z q " * 3 + "#<>|", "en")]
    return rows


def test_rows_against_plain(llm, none):
    rows = cases()
    df = llm.createDataFrame([(*r, 1, 2, "x", True) for r in rows], "doc_id long, text string, lang string, n long, class int, word string, kept boolean").repartition(4)
    got = sorted((tuple(r) for r in quality_rules.verdicts(df).collect()), key=repr)
    assert got == plain_rows(rows)
    assert {r[0] for r in got if r[7]} & {200, 201, 202, 300, 301, 302, 401} == set()
    assert quality_rules.verdicts(none).count() == 0
    unnamed = quality_rules.verdicts(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert all(r["kept"] != r["base_failed"] for r in unnamed)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_windows(seed):
    rng = random.Random(seed)
    lists = [[rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(0, 120))] for _ in range(5)]
    flat, text = np.array([w for x in lists for w in x], np.int64), np.repeat(np.arange(5), [len(x) for x in lists])
    want = []
    for x in lists:
        seen = Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
        covered = {i + o for i in range(len(x) - 4) if seen[tuple(x[i : i + 5])] > 1 for o in range(5)}
        want += [i in covered for i in range(len(x))]
    assert repeated_windows(flat, text).tolist() == want


def test_a_text_beyond_the_slice():
    text = ("first five words of it " + " ".join(str(i) for i in range(450_000)) + " first five words of it é").encode()
    m = Measures([b"", text, b"x"])
    assert m.n_words.tolist() == [0, 450_011, 1] and m.n_repeat_words.tolist() == [0, 10, 0]
    assert m.word_chars[1] == len(re.sub(r"\s", "", text.decode()))


def test_hot_words_and_lines(llm):
    """One line in a third of all rows, one word in all: counted in slices first, so the shuffle has few rows."""
    df = llm.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('the same line once more\n', 3) else concat('the ', repeat(concat(id, ' of '), 2), 'and so on we go to it now') end as text", "'en' as lang")
    got = quality_rules.verdicts(df)
    assert got.filter("base_failed").count() == 1000 and got.filter("kept").count() == 2000


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_against_sql(llm, scale):
    name, folder = "op13_quality_rules", f"/root/testdata/{scale}"
    con = duck(folder)
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert difference(catalogue.QUERIES[name](llm, folder), con, catalogue.SQL[name]) is None


def test_junk_goes_and_prose_stays(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.verdicts(docs).filter("n_words >= 100").join(labels, "doc_id")
    prose, junk = got.filter("quality = 1 and not base_failed"), got.filter("quality = 0")
    assert prose.filter("kept").count() > 0.97 * prose.count()
    assert junk.filter("not kept").count() > 0.9 * junk.count()
