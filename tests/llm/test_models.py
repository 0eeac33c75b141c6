"""Classifiers on held-out rows, vector search against brute force, queries and pipeline."""

import numpy as np
import pytest
from compare import difference, duck

import corpus_pipeline
from taxaledger.llm import catalogue, language_gru, quality_cnn, training_rows, vector_search
from taxaledger.llm.vp_tree import Search, build, distances


def test_language_of_odd_rows(odd, none, llm):
    got = language_gru.predictions(odd).collect()
    assert len(got) == odd.count()
    letterless = [r["doc_id"] for r in odd.filter("text is null or not text rlike '\\\\p{L}'").collect()]
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in letterless and r["doc_id"] is not None and r["doc_id"] != 3:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["doc_id"] not in letterless:
            assert r["lang_pred"] in ("en", "de")
    assert language_gru.predictions(none).count() == 0


def test_language_learns_nothing_from_held_out_rows(llm):
    rows = [(i, "der die das und nicht mit " * 4, "de") for i in range(60)] + [(100 + i, "the of and with that is " * 4, "en") for i in range(60)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    changed = df.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 3 = 1 then 'xx' else lang end as lang")
    a, b = language_gru.train(df), language_gru.train(changed)
    assert a.langs == b.langs == ["de", "en"]
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)


def test_gru_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    u = language_gru.UNITS
    w = {"in_l": rng.normal(0, 0.5, (256, 3 * u)), "re_l": rng.normal(0, 0.5, (u, 3 * u))}
    data = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    states, kept = language_gru.forward(w, "l", data, True)
    d = rng.normal(0, 1, states.shape)
    grads = {k: np.zeros_like(x) for k, x in w.items()}
    language_gru.backward(w, "l", data, kept, d, grads)
    for k, at in (("re_l", (1, 2)), ("re_l", (3, 2 * u + 1)), ("in_l", (int(data[2, 1]), u + 3))):
        loss = []
        for step in (1e-2, -1e-2):
            v = {n: x.copy() for n, x in w.items()}
            v[k][at] += step
            loss.append((language_gru.forward(v, "l", data)[0] * d).sum())
        assert grads[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=0.02, abs=1e-3)


def test_language_on_held_out_documents(llm):
    df = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_gru.predictions(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() > 0.97 * got.count()


def test_quality_on_held_out_documents(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_cnn.predictions(docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.filter("quality = predicted").count() > 0.93 * got.count()


def test_quality_of_odd_rows(llm, odd, none):
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (900, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_cnn.predictions(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality_cnn.predictions(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_cnn.predictions(none, labels).count() == 0
    kept = quality_cnn.score(odd, quality_cnn.fit([]), keep=tuple(odd.columns))
    assert kept.columns == [*odd.columns, "_score"] and kept.count() == odd.count()


def test_every_byte_counts():
    """Pooled chunks cover texts of any length: one odd byte anywhere changes the score."""
    net = quality_cnn.fit([(1, "aaaa " * 60), (0, "%%%% " * 60)] * 4)
    tables = quality_cnn.pair_tables(net)
    for n in (1, 127, 128, 129, 700):
        base = quality_cnn.text_logits([b"a" * n], net, tables)[0]
        assert all(quality_cnn.text_logits([b"a" * i + b"%" + b"a" * (n - i - 1)], net, tables)[0] != base for i in {0, n // 2, n - 1})


def test_exact_search_with_factor_one():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 700, axis=0)))
    ids, q = rng.permutation(len(x)).astype(np.int64), np.arange(0, len(x), 37)
    best, got = Search(build(x), x, ids, np.arange(len(x)), x[q], q, 10, 1.0).run()
    d = distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :10]
    assert (got == ids[order]).all() and (best == np.take_along_axis(d, order, 1)).all()


def test_search_of_odd_vectors(llm):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4)], 0) for i in range(60)]
    rows += [(100, [1.0, 2.0], 1), (200, None, 1), (300, [0.0] * 4, 1), (400, [float("nan")] * 4, 1), (500, [1.0, None, 2.0, 3.0], 1), (None, [1.0] * 4, 1), (600, [], 1), (0, rows[5][1], 2), (700, [float("inf")] * 4, 1)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, row int")
    got = vector_search.search(df, every=20, factor=1.0, shard_rows=16, k=5).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}  # 100 has no candidate of its length
    x = {i: np.array(v) for i, v, _ in rows[:60]}
    for q in (20, 40):
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in [*x.items(), (0, np.array(rows[5][1]))] if i != q)[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"]) for r in mine] == [i for _, i in want] and [r["score"] for r in mine] == pytest.approx([s for s, _ in want])
    assert vector_search.search(df.limit(0)).count() == 0


def test_recall(llm):
    df = llm.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    near, exact = (vector_search.search(df, factor=f, shard_rows=1000).select("query_id", "vec_id").collect() for f in (vector_search.FACTOR, 1.0))
    assert len(set(near) & set(exact)) >= 0.95 * len(exact)


def test_recall_where_vectors_span_few_dimensions(llm):
    rng = np.random.default_rng(11)
    x = np.tanh(rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 64)) / 3)
    df = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in vector_search.search(df, every=30, shard_rows=1500).collect()}
    q = np.arange(0, len(x), 30)
    d = distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    assert got == {(int(a), n + 1, int(b)) for a, near in zip(q, np.argsort(d, axis=1, kind="stable")[:, :10], strict=True) for n, b in enumerate(near)}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(llm, folder, name):
    con = duck(folder)
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    assert difference(catalogue.QUERIES[name](llm, folder), con, catalogue.SQL[name]) is None


def test_pipeline_keeps_columns_and_removes(llm, odd, folder):
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, folder)
        assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()
        assert stage(llm, odd, folder).columns == odd.columns
        docs = out
    assert docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    assert corpus_pipeline.run(llm, folder).count() > 0


def test_pipeline_of_an_empty_table(llm, none, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, none, folder).count() == 0


def test_recall_against_brute_force(llm):
    df = llm.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vector_search.usable(df).collect()
    by_length = {}
    for r in rows:
        by_length.setdefault(r["dim"], []).append(r)
    got = {}
    for r in vector_search.search(df, shard_rows=300).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for group in by_length.values():
        x, ids = np.array([r["v"] for r in group]), np.array([r["vec_id"] for r in group])
        for q in np.flatnonzero(ids % 100 == 0):
            d = distances(x[q : q + 1], x)[0]
            d[q] = np.inf
            near = [i for i in np.lexsort((ids, d))[:10] if np.isfinite(d[i])]
            assert got.get(int(ids[q]), set()) == {int(ids[i]) for i in near}


def test_search_cells_use_a_task_each(llm):
    """With one block of queries, every tree is searched in a cell of its own."""
    rng = np.random.default_rng(4)
    df = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    rows = vector_search.usable(df).withColumn("row", vector_search.F.col("vec_id"))
    index = vector_search.trees(rows, 600, 75)
    plan = vector_search.nearest(index, rows.filter("vec_id % 20 = 0"), 30)
    assert "hashpartitioning(shard" in plan._jdf.queryExecution().toString() and index.count() == 8
    several = vector_search.nearest(index, rows, 600, block_rows=20)  # 30 blocks, two parts
    assert several.count() == 6000 and {tuple(r) for r in plan.collect()} <= {tuple(r) for r in several.collect()}


def test_training_rows_are_whole_and_bounded(llm):
    rows = [(i, "x" * (10 + i), "ab"[i % 2]) for i in range(400)] + [(1000, "y" * 5000, "a"), (1001, None, "b"), (None, "z", "a"), (7, "w", None), (1002, "", "b")]
    df = llm.createDataFrame(rows, "doc_id long, text string, label string")
    whole = {t for _, t, _ in rows}
    got = training_rows.training_texts(training_rows.thinned(df, 50, "doc_id"), 50, 12_000)
    assert all(t in whole and 0 < len(t) <= 3000 for _, t in got)
    for label in "ab":
        held = [t for k, t in got if k == label]
        assert 20 < len(held) <= 75 and sum(map(len, held)) <= 12_000
    everything = training_rows.training_texts(training_rows.thinned(df, 1000, "doc_id"), 1000, 1 << 20)
    assert sorted(t for _, t in everything) == sorted(t for i, t, k in rows if i is not None and t and k)


def test_a_row_trains_under_its_own_label_only(llm):
    rows = [(5, "der die das", "de"), (5, "the of and", None)] * 3
    df = llm.createDataFrame(rows, "doc_id long, text string, label string")
    assert set(training_rows.training_texts(training_rows.thinned(df, 10, "doc_id"), 10, 1000)) == {("de", "der die das")}


def test_quality_score_position_by_position():
    """The pooled network against its definition, one filter and place at a time."""
    net = quality_cnn.fit([(1, "good words here " * 30), (0, "#$%& 123 junk " * 30)] * 3)
    for text in (b"", b"ab", b"q" * 128, bytes(range(256)) * 3, "é ü # words ".encode() * 40):
        blocks = max(1, -(-len(text) // quality_cnn.BLOCK))
        padded = text.ljust(blocks * quality_cnn.BLOCK, b"\0") + b"\0" * quality_cnn.WIDTH
        starts = range(0, max(1, blocks - 1) * quality_cnn.BLOCK, quality_cnn.BLOCK)
        size = min(2, blocks) * quality_cnn.BLOCK
        logits = []
        for s in starts:
            at = [sum(net.taps[k, padded[i + k]] for k in range(quality_cnn.WIDTH)) for i in range(s, s + size)]
            logits.append(np.maximum(np.max(at, axis=0) + net.bias, 0) @ net.out + net.out_bias)
        assert quality_cnn.text_logits([text], net, quality_cnn.pair_tables(net))[0] == pytest.approx(np.mean(logits), abs=1e-4)


def test_language_probabilities_position_by_position():
    """The network against its equations, one byte at a time."""
    rng = np.random.default_rng(9)
    u = language_gru.UNITS
    net = language_gru.Network(["a", "b", "c"], {"out": rng.normal(size=(2 * u, 3)), "bias": rng.normal(size=3)})
    for side in "lr":
        net.weights |= {f"in_{side}": rng.normal(size=(256, 3 * u)), f"re_{side}": rng.normal(size=(u, 3 * u))}
    sig = lambda x: 1 / (1 + np.exp(-x))
    text = "Straße, ça và 42. ".encode() * 12
    labels = []
    for b in range(0, len(text), language_gru.STEPS):
        run = text[b : b + language_gru.STEPS].ljust(language_gru.STEPS, b"\0")
        states = {}
        for side, order in (("l", range(len(run))), ("r", range(len(run) - 1, -1, -1))):
            h = np.zeros(u)
            for t in order:
                x, inner = net.weights[f"in_{side}"][run[t]], net.weights[f"re_{side}"]
                z, r = sig(x[:u] + h @ inner[:, :u]), sig(x[u : 2 * u] + h @ inner[:, u : 2 * u])
                h = z * h + (1 - z) * np.tanh(x[2 * u :] + r * (h @ inner[:, 2 * u :]))
                states[side, t] = h
        for t in range(min(language_gru.STEPS, len(text) - b)):
            e = np.exp(np.concatenate((states["l", t], states["r", t])) @ net.weights["out"] + net.weights["bias"])
            labels.append(e / e.sum())
    assert language_gru.probabilities([text], net)[0] == pytest.approx(np.mean(labels, axis=0), abs=1e-4)


def test_a_very_long_text_is_read_to_its_end(llm):
    long = "the of and with that is " * 90_000  # over 2 MB
    df = llm.createDataFrame([(1, long), (2, long + "%%%%#### " * 90_000)], "doc_id long, text string")
    lang = language_gru.fit([("en", "the of and with that is " * 9), ("xx", "%%%%#### " * 30)])
    a, b = language_gru.predict(df, lang).orderBy("doc_id").collect()
    assert a["lang_pred"] == "en" and b["score"] < a["score"]
    net = quality_cnn.fit([(1, "the of and with that is " * 40), (0, "%%%%#### " * 90)] * 3)
    a, b = quality_cnn.score(df, net).orderBy("doc_id").collect()
    assert b["score"] < a["score"]
