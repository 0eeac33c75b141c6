"""Tokenizer operators against the library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from taxaledger.llm import bpe_codec, token_counts, token_store
from taxaledger.llm.token_counts import Counter

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "B", " ", "  ", "\n", "é", "́", "Σ", "'s", "1", "²", "<|endoftext|>", "\x1d", "\x85", "　", "​", "한", "ä", "%", "\xa0"]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def mixtures(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_codec_is_the_library(word):
    codec, texts = bpe_codec.codec(WORD), [*mixtures(2000, 1), "a" * 3000, "ΟΔΟΣ İ ﬁ ½ I'LL don't"]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        want = word.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(text)
        assert codec.decode(ids) == word.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>" * 5000, "\ufeffsome text " + "b<|startoftext|>a <|endoftext|>" * 2500], ids=["unit", "doubtful"])
def test_thousands_of_special_strings(word, text):
    want = word.encode(text, add_special_tokens=False).ids
    assert bpe_codec.Codec(WORD).encode(text) == " ".join(map(str, want)) and len(want) >= 5000


def test_byte_units_are_the_library(byte):
    texts = mixtures(3000, 2)
    for text, raw in zip(texts, token_store.tokenizer(BYTE).encode_batch(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids, repr(text)


def test_small_memos_change_nothing(byte):
    small, texts = token_store.ByteTokenizer(BYTE, memo_units=20), mixtures(300, 3)
    assert [small.encode_batch([t])[0] for t in texts] == token_store.tokenizer(BYTE).encode_batch(texts)


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (200, 16), (5000, 512)])
def test_splices_count_as_the_whole(word, chunk, overlap):
    counter, rng = Counter(WORD, chunk, overlap), random.Random(chunk)
    for text in [*mixtures(200, 4), "a" * 3000, " ".join("w" * rng.randint(1, 90) for _ in range(200)), "b " * 900, "x" + "　y" * 300]:
        assert counter.count_batch([text]) == [len(word.encode(text, add_special_tokens=False).ids)], repr(text[:50])


def test_counts_of_odd_rows(odd, none, word):
    got = sorted(map(tuple, token_counts.count_tokens(odd, WORD, limit=50, chunk=500, overlap=16).collect()), key=repr)
    want = []
    for r in odd.collect():
        n = len(word.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 50))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(none, WORD).count() == 0


def test_round_trip_of_odd_rows(odd, none, word):
    got = sorted(map(tuple, bpe_codec.round_trip_digests(odd, WORD).collect()), key=repr)
    sha, want = lambda s: hashlib.sha256(s.encode()).hexdigest(), []
    for r in odd.collect():
        ids = word.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    decoded = bpe_codec.decode_documents(bpe_codec.encode_documents(odd, WORD), WORD)
    assert sorted(sha(r["text"]) for r in decoded.collect()) == sorted(w[3] for w in want)
    assert bpe_codec.round_trip_digests(none, WORD).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000, 1 << 16])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    assert (token_store.from_planes(token_store.to_planes(ids, kind), n) == ids).all()


def test_joined_checksums():
    a, b = b"some bytes" * 9, b"and others" * 70
    assert token_store.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_store_of_odd_rows(llm, odd, byte, tmp_path, kind):
    """Blocks of 64 ids, so that documents span several."""
    token_store.write_store(odd, str(tmp_path / "s"), BYTE, block_ids=64, kind=kind)
    got = sorted(token_store.document_checksums(llm, str(tmp_path / "s")).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = []
    for r in odd.collect():
        raw = np.array([*byte.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], len(raw), zlib.crc32(raw.tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    pieces = token_store.read_ids(llm, str(tmp_path / "s"))
    assert pieces.selectExpr("sum(size(ids))").first()[0] == at
    index = llm.read.parquet(str(tmp_path / "s" / "index"))
    assert index.filter(f"size(plane_bytes) <> {4 if kind == 'byte' else 32} or n_ids > 64").count() == 0


def test_store_of_an_empty_table(llm, none, tmp_path):
    token_store.write_store(none, str(tmp_path / "s"), BYTE)
    assert token_store.document_checksums(llm, str(tmp_path / "s")).count() == 0
