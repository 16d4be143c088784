"""Huffman-coded id files against the library and plain Python: codes, packing, random access, documents across blocks."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from texelmill.llm import idfiles
from texelmill.llm.queries import QUERIES
from texelmill.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def least_bits(counts, most):
    """Total bits of the best code with at most ``most`` bits, by trying every way to give lengths (falling counts get rising lengths)."""
    w = sorted((c for c in counts if c), reverse=True)

    def best(i, room, length):
        if i == len(w):
            return 0
        out = float("inf")
        for bits in range(length, most + 1):
            cost = 2 ** (most - bits)
            if cost <= room:
                out = min(out, w[i] * bits + best(i + 1, room - cost, bits))
        return out

    return best(0, 2**most, 1)


def test_lengths_are_the_best_under_the_limit():
    rng = random.Random(2)
    for _ in range(120):
        n, most = rng.randrange(2, 8), rng.randrange(3, 6)
        counts = np.array([rng.choice([0, 1, 1, 2, 5, 40, 1000]) for _ in range(n)])
        if np.count_nonzero(counts) < 2:
            continue
        bits = idfiles.code_lengths(counts, most).astype(int)
        assert bits.max() <= most and ((bits > 0) == (counts > 0)).all()
        assert sum(2.0 ** -b for b in bits if b) == 1
        assert (bits * counts).sum() == least_bits(counts, most)


def test_codes_are_canonical():
    code = idfiles.Code(np.array([3, 0, 1, 3, 2]))
    assert [format(int(code.codes[i]), f"0{code.lengths[i]}b") for i in (2, 4, 0, 3)] == ["0", "10", "110", "111"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_pack_and_unpack(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 2000).astype(np.int32)
    counts = np.bincount(np.append(ids, np.arange(2001)))
    code = idfiles.Code(idfiles.code_lengths(counts, 12))
    assert code.most <= 12
    first = np.array([0, n // 3, n // 3, n // 2, n])
    words, word_of, begin = code.pack(ids, first)
    bits = words.byteswap().tobytes()
    sizes = np.diff(first)
    marks = np.concatenate([begin[a:b:64] for a, b in zip(first, first[1:])]) if n else np.zeros(0, np.int64)
    assert (code.unpack(bits, marks, sizes) == ids).all()
    for i, (a, b) in enumerate(zip(first, first[1:])):
        plain = "".join(format(int(code.codes[x]), f"0{code.lengths[x]}b") for x in ids[a:b])
        own = bits[8 * word_of[i] : 8 * word_of[i + 1]]
        assert len(own) == -(-len(plain) // 64) * 8 and "".join(format(x, "08b") for x in own)[: len(plain)] == plain
        assert (code.unpack(own, begin[a:b:64] - 64 * word_of[i], sizes[i : i + 1]) == ids[a:b]).all()
        if b - a > 64:  # from a checkpoint within
            assert (code.unpack(own, begin[a:b:64][1:2] - 64 * word_of[i], np.array([min(64, b - a - 64)])) == ids[a + 64 : min(b, a + 128)]).all()


def test_one_symbol_and_uncounted_ids():
    code = idfiles.Code(idfiles.code_lengths(np.array([0, 0, 7])))
    words, _, begin = code.pack(np.full(100, 2), np.array([0, 100]))
    assert (code.unpack(words.byteswap().tobytes(), begin[::64], np.array([100])) == 2).all()
    with pytest.raises(ValueError):
        code.pack(np.array([1]), np.array([0, 1]))


def test_segments_do_not_change_ids(library):
    rng = random.Random(5)
    pool = "'' \t\n\r srtvemldSL1²é½ß字　\xa0.,-!🙂a\x1c\x1f\x85\x00́"
    texts = ["", "<|endoftext|> a", *("".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4000))]
    words = ["don't", "we'll,", "a\nb", "\tx", "a,'s", "(b)", "***", "é.", "ß", "n1", "naïve!", "x\x85y", "\0", "µ", "", "e\u0301"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    got = idfiles.Encoder(PATH).encode(pa.array(texts))
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(idfiles, "REMEMBERED", 3)
    monkeypatch.setattr(idfiles, "LONGEST", 4)
    encoder = idfiles.Encoder(PATH)
    for text in ("one two three four five", "two three seven eight", "one two three four five"):
        assert np.frombuffer(encoder.encode(pa.array([text]))[0], np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 12


def test_files(spark, tmp_path, monkeypatch):
    """Null and equal ids, rows without ids, documents longer than a block and the order of all."""
    rng = random.Random(7)
    sizes = [0, 1, 5, 70000, 65536, 65537, 200_001, 0, 3, 3, 40000, 40000, 0]
    ids = [[rng.randrange(300) for _ in range(n)] for n in sizes]
    names = [9, 4, None, 7, 3, 3, 1, None, 2, 2, 12, -5, 100]
    ids[9] = ids[8]  # equal rows
    rows = list(zip(names, [None if i == 7 else x for i, x in enumerate(ids)], ["x"] * len(ids)))
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>, part string").repartition(3)
    from texelmill.session import cut_lineage

    folder = str(tmp_path / "out")
    idfiles.write_ids(cut_lineage(docs), folder)
    got = sorted(idfiles.read_ids(spark, folder).collect(), key=lambda r: (r.start, len(r.ids)))
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(((d, x or []) for d, x, _ in rows), key=repr)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got if r.ids]
    assert order == sorted(order)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.agg({"n": "max"}).first()[0] == 65536 and blocks.where("goes_on").count() >= 5


def test_files_of_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, ids array<int>")
    idfiles.write_ids(docs, str(tmp_path / "none"))
    assert idfiles.read_ids(spark, str(tmp_path / "none")).collect() == []
    docs = spark.createDataFrame([("a", []), ("b", None)], "doc_id string, ids array<int>")
    idfiles.write_ids(docs, str(tmp_path / "empty"))
    assert sorted((r.doc_id, r.start, r.ids) for r in idfiles.read_ids(spark, str(tmp_path / "empty")).collect()) == [("a", 0, []), ("b", 0, [])]


def test_encode_documents(spark, library):
    texts = [None, "", " a  b\n", "x" * 300_000 + " end", "same", "same"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in idfiles.encode_documents(docs, PATH, end_id=2).collect()}
    for i, t in enumerate(texts):
        assert rows[i].text == t and rows[i].ids == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert idfiles.encode_documents(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_token_files"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    at = 0
    for d in sorted(texts):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_checksums_of_documents_across_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(70000) for _ in range(n)]) for i, n in enumerate([3, 0, 140_000, 65536, 9])]
    idfiles.write_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), str(tmp_path / "out"))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in idfiles.read_checksums(spark, str(tmp_path / "out")).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows}


def test_counts_of_the_encoder(spark):
    texts = [f"some words {i} and words" * (i % 7) for i in range(50)] + [None]
    docs = idfiles.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), PATH, end_id=2, counts="counts")
    assert (idfiles.count_ids(docs) == idfiles.count_ids(docs, counts="counts")).all() and idfiles.count_ids(docs)[2] >= 51
    assert idfiles.count_ids(docs.limit(0), counts="counts").tolist() == []


def test_packed_ids():
    """Rows of 2 and of 4 bytes an id side by side, empty and null ones."""
    ids = [[5, 65535], [], [65536, 3], None]
    column = pa.array([None if x is None else idfiles._packed(np.array(x, np.int32).tobytes()) for x in ids], pa.binary())
    values, first = idfiles._flat(column)
    assert values.dtype == np.int32 and values.tolist() == [5, 65535, 65536, 3] and first.tolist() == [0, 2, 2, 4, 4]
    assert [len(x or b"") for x in column.to_pylist()] == [5, 1, 9, 0]


def test_packed_documents_make_the_same_files(spark, tmp_path):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60)
    found = []
    for packed in (False, True):
        docs = cut_lineage(idfiles.encode_documents(texts, PATH, end_id=2, counts="counts", packed=packed).drop("text"))
        idfiles.write_ids(docs, str(tmp_path / str(packed)), counts="counts")
        found.append(sorted(idfiles.read_ids(spark, str(tmp_path / str(packed))).collect()))
    assert found[0] == found[1] and len(found[0]) == 60


def test_ranges_come_from_keys_alone(spark, tmp_path, monkeypatch):
    """Ids are looked at twice, to count and to code them: finding the ranges of documents coded all of them a third time."""
    monkeypatch.setattr(idfiles, "PART", 100)
    seen = spark.sparkContext.accumulator(0)

    def make(i):
        seen.add(1)
        return [i % 7] * (i % 5)

    keys = [None if i % 11 == 0 else f"{'é' if i % 3 else 'z'}{i * 37 % 50}" for i in range(400)]
    docs = spark.createDataFrame(list(zip(range(400), keys)), "i int, doc_id string").select("doc_id", F.udf(make, "array<int>")("i").alias("ids"))
    idfiles.write_ids(docs, str(tmp_path / "out"))
    assert seen.value == 800
    rows = sorted(idfiles.read_ids(spark, str(tmp_path / "out")).collect(), key=lambda r: (r.start, len(r.ids)))
    assert sorted((r.doc_id or "", r.ids) for r in rows) == sorted((k or "", [i % 7] * (i % 5)) for i, k in enumerate(keys))
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) for r in rows)])[:-1].tolist()
    order = [r.doc_id for r in rows if r.ids]
    assert order == sorted(order, key=lambda k: (k is not None, k or ""))
    assert spark.read.parquet(str(tmp_path / "out" / "blocks")).select("part").distinct().count() > 1


def test_line_ends_between_words(library):
    texts = ["a line\nand another.\nThird", "one\n\ntwo", "x \ny", "x\n y", "a\n", "\na", "tab\t\nend", "it's\n's", "'\n'll\n9"]
    got = idfiles.Encoder(PATH).encode(pa.array(texts))
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
