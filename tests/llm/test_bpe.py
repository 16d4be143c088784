"""Encoding against the tiktoken library, decoding as an exact round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from texelmill.llm import bpe, words

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def encode(vocab, texts):
    data, at = words.text_buffer(pa.array(texts, pa.string()))
    ids, first = vocab.encode(data, at)
    return [ids[first[i] : first[i + 1]].tolist() for i in range(len(texts))]


def test_random_texts_of_awkward_characters(vocab, library):
    rng = random.Random(5)
    pool = "'' \t\n\r srtvemldSL1²é½ß字　\xa0.,-!🙂a\x1c\x00́<|endoftext|>"
    texts = ["", *("".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(5000))]
    assert encode(vocab, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_two_byte_character(vocab, library):
    texts = [f"a{chr(i)}a1{chr(i)}1 {chr(i)}  {chr(i)}!{chr(i)}" for i in range(0x3100)]
    texts += [f"a{chr(i)}a1{chr(i)} {chr(i)}" for a, b in bpe.BLOCKS_16 for i in range(a, b + 1)]
    assert encode(vocab, texts) == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_exact(vocab):
    assert sorted(vocab.table.slot_of.tolist()) == list(range(len(vocab.ranks)))
    other = np.random.default_rng(1).integers(0, 2**63, 10000, dtype=np.int64).astype(np.uint64)
    assert (vocab.table.find(other) == -1).all()
    assert (vocab.table.find(vocab.table.keys) == np.arange(len(vocab.ranks))).all()


def test_documents(spark, library):
    texts = [None, "", "x" * 200_000 + " end", "Don't we'll  go\n\n", "Don't we'll  go\n\n", "🙂" * 50]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode_ordinary(t or "")
        assert bytes(rows[i].decoded) == (t or "").encode()
        assert rows[i].text == t
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0), PATH), PATH).count() == 0


def test_query(spark, library):
    from texelmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op2_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def thue_morse(n):
    """Two words of n letters that every sum of powers modulo 2 ** 64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 64, 1024, 2048])
def test_pre_tokens_of_equal_sums(spark, vocab, library, n):
    texts = [f"{x} {y}, {x}{y}" for x in thue_morse(n) for y in thue_morse(n)]
    assert encode(vocab, texts) == [library.encode_ordinary(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.encode_documents(docs, PATH, back="back", exact="exact").collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and bytes(r.back).decode() == texts[r.doc_id] and r.exact


def test_equal_hashes_change_nothing(library, monkeypatch):
    """With one hash for all that isn't in the vocabulary, bytes still decide."""
    own = bpe.Vocabulary(PATH)
    token = next(iter(own.ranks))
    key = bpe.byte_hashes(np.frombuffer(token, np.uint8), np.array([0]), np.array([len(token)]))
    monkeypatch.setattr(bpe, "byte_hashes", lambda data, a, b: np.repeat(key, len(a)))
    texts = ["every word of this", "has the same hash, has it?", "! !!"]
    assert encode(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode_at_once(spark, library):
    texts = [None, "", "x" * 700_000 + " end", "Don't we'll  go\n\n", "🙂" * 50, "b", "\u0130 ß"]
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, exact int")
    out = bpe.encode_documents(docs, PATH, back="back", exact="exact")
    assert out.columns == ["doc_id", "text", "ids", "back", "exact"]
    for r in out.collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "") and bytes(r.back) == (texts[r.doc_id] or "").encode() and r.exact and r.text == texts[r.doc_id]
