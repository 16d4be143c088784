"""Byte-level BPE over a rank file: encoding by a two-tier lookup, and decoding.

A text is cut into pre-tokens, a piece of many texts at a time. Tier one looks up every different pre-token of the piece in a minimal
perfect hash of the vocabulary; what is not a whole token is merged in tier two, with a heap of candidate merges over linked bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from texelmill.llm import words
from texelmill.llm.words import U, byte_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Blocks assigned in Unicode 16.0, which the usual tokenizer library knows and this Python's tables may not.
BLOCKS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)
#: Different missed pre-tokens that a Python worker remembers, and the longest of them in bytes; beyond that it starts anew.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of texts that are encoded at once; a longer text is a piece of its own.
PIECE = 1 << 19


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    out[:] = [kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)]
    for a, b in BLOCKS_16:
        for i in range(a, b + 1):
            if unicodedata.category(chr(i)) == "Cn":
                out[i] = LETTER if regex.match(r"\p{L}", chr(i)) else NUMBER if regex.match(r"\p{N}", chr(i)) else OTHER
    out[list(WHITE_SPACE)] = SPACE
    return out


def pre_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pre-tokens of consecutive texts begin, and the first pre-token of each text.

    The same cuts as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+``: runs of one class, one space before a run belonging to it, the
    rest of the white space apart, and contractions ahead of the letters they begin.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    size = np.ones(n, np.int8)
    for least in (0x80, 0x800, 0x10000):
        size += points >= least
    byte = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=byte[1:])
    text_start = np.searchsorted(byte, at)
    kind = classes()[points]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)  # where a text begins, and the end
    edge[text_start] = True
    start |= edge

    runs = np.flatnonzero(start)
    last = runs[1:] - 1
    last = last[(kind[last] == SPACE) & ~edge[last + 1]]  # last of the white space that something follows
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False

    quote = np.flatnonzero((points == 0x27) & start[:n] & ~edge[1 : n + 1])
    quote = quote[quote + 1 < n]
    one = points[quote + 1]
    two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
    is_one = np.isin(one, [ord(c) for c in "stmd"])
    is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for found, long in ((quote[is_one], 1), (quote[is_two], 2)):
        start[found + 1] = False
        start[found + 1 + long] = True
    begin = np.flatnonzero(start[:n])
    return byte[begin], np.searchsorted(begin, text_start)


class PerfectHash:
    """Minimal perfect hash of 64-bit keys by hash and displace: a displacement per bucket of keys puts each key in a slot of its own."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = n // 4 + 1
        bucket = (keys % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate(([0], np.cumsum(sizes)))
        free = np.ones(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(n, np.int64)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[first[b] : first[b + 1]]
            if len(own) == 1:
                singles.append((b, own[0]))
            elif len(own):
                base = 1
                while True:
                    tries = np.arange(base, base + 64)
                    slots = self._slot(keys[own][None, :], tries[:, None])
                    good = free[slots].all(axis=1)
                    good &= np.array([len(set(s)) == len(own) for s in slots.tolist()])
                    if good.any():
                        k = int(np.argmax(good))
                        break
                    base += 64
                self.shift[b], self.slot_of[own] = tries[k], slots[k]
                free[slots[k]] = False
        for (b, key), slot in zip(singles, np.flatnonzero(free)):  # a bucket of one names its slot
            self.shift[b], self.slot_of[key] = -slot - 1, slot
        self.keys = np.zeros(n, U)
        self.keys[self.slot_of] = keys

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (words.mix(keys + shift.astype(U) * U(0x9E3779B97F4A7C15)) % U(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys outside the set."""
        shift = self.shift[(keys % U(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slot(keys, np.maximum(shift, 0)))
        return np.where(self.keys[slot] == keys, slot, -1)


class Vocabulary:
    """A rank file: one base64 token and its rank a line."""

    def __init__(self, path: str, table: PerfectHash | None = None):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = list(self.ranks)
        if table is None:
            at = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
            table = PerfectHash(byte_hashes(np.frombuffer(b"".join(tokens), np.uint8), at[:-1], at[1:]))
        self.table = table
        self.token_at = np.zeros(len(tokens), np.int64)  # by slot
        self.token_at[self.table.slot_of] = list(self.ranks.values())
        self.by_id: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.by_id[rank] = token
        self.sizes = np.array([len(t or b"") for t in self.by_id])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flat = np.frombuffer(b"".join(t or b"" for t in self.by_id), np.uint8)
        self.single = [np.int32(i).tobytes() for i in range(len(self.by_id))]
        self.merged: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ranks of a piece, as 32-bit integers: the pair of neighbours of least rank merges first, the left one of equals."""
        ranks, n = self.ranks, len(piece)
        after = [*range(1, n + 1), n]  # where the part that begins here ends and the next begins; n for parts that are gone
        before = [*range(-1, n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if middle >= n or after[middle] != end:
                continue
            after[i], after[middle] = end, n
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return array("i", out).tobytes()

    def _missed(self, piece: bytes) -> bytes:
        if (ids := self.merged.get(piece)) is None:
            ids = self.merge(piece)
            if len(piece) <= LONGEST:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[piece] = ids
        return ids

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and the first id of each."""
        start, first = pre_tokens(data, at)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        cuts = np.append(start, len(data)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(tokens)  # equal where the bytes are
        code, some = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        upto = np.concatenate(([0], np.cumsum([len(t) for t in some])))
        slot = self.table.find(byte_hashes(np.frombuffer(b"".join(some), np.uint8), upto[:-1], upto[1:]))
        ids = np.where(slot >= 0, self.token_at[slot], 0).tolist()
        by_id, single, missed = self.by_id, self.single, self._missed
        parts = [single[i] if by_id[i] == t else missed(t) for i, t in zip(ids, some)]  # the hash names a candidate, its bytes decide
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.concatenate(([0], np.cumsum(size)))
        flat = np.frombuffer(b"".join(parts), np.int32)
        count = size[code]
        upto = np.concatenate(([0], np.cumsum(count)))
        return flat[np.arange(upto[-1]) + np.repeat(begin[:-1][code] - upto[:-1], count)], upto[first]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a row of ids, and the first byte of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.by_id)):
            raise ValueError("an id outside the vocabulary")
        size = self.sizes[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.arange(upto[-1]) + np.repeat(self.first[ids] - upto[:-1], size)], upto


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str, table: PerfectHash | None = None) -> Vocabulary:
    """The vocabulary of a file that every machine has; kept for the life of the process. ``table`` spares building the hash anew."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path, table)
    return _loaded[path]


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], column], [*names, name])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, kind)])


def encode_documents(docs: DataFrame, ranks: str, text: str = "text", out: str = "ids", back: str | None = None, exact: str | None = None) -> DataFrame:
    """The same rows plus ``out``, array<int>: the ids of the whole text by the rank file ``ranks``, without special tokens.

    The ids are decoded at once where asked: ``back``, binary, is what they give, ``exact`` whether that is the text's bytes. A null text counts as empty and has no ids. Columns of the new names are
    replaced; all others are kept. No shuffle; a worker holds one Arrow batch, cut to pieces of PIECE bytes (a longer text is a piece of its own), the vocabulary and at most REMEMBERED merged pre-tokens.
    """

    table = vocabulary(ranks).table  # built once, on the driver: a few bytes a token

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks, table)
        for batch in batches:
            data, at = words.text_buffer(batch.column(text))
            for a, b in words.pieces(at, PIECE):
                own, cuts = data[at[a] : at[b]], at[a : b + 1] - at[a]
                ids, first = vocab.encode(own, cuts)
                rows = _put(batch.slice(a, b - a), out, pa.ListArray.from_arrays(first.astype(np.int32), ids))
                if back or exact:
                    got, upto = vocab.decode(ids)
                    ends = upto[first]
                    if back:
                        rows = _put(rows, back, pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(got))]))
                    if exact:
                        if len(got) == len(own) and (ends == cuts).all():
                            wrong = np.concatenate(([0], np.cumsum(got != own)))
                            same = wrong[cuts[1:]] == wrong[cuts[:-1]]
                        else:
                            same = np.array([got[ends[i] : ends[i + 1]].tobytes() == own[cuts[i] : cuts[i + 1]].tobytes() for i in range(b - a)], bool)
                        rows = _put(rows, exact, pa.array(same))
                yield rows

    schema = _with(docs, out, T.ArrayType(T.IntegerType()))
    for name, kind in ((back, T.BinaryType()), (exact, T.BooleanType())):
        if name:
            schema = T.StructType([*[f for f in schema.fields if f.name != name], T.StructField(name, kind)])
    return docs.mapInArrow(encode, schema)


def decode_documents(docs: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The same rows plus ``out``, binary: the bytes of the ids. Null ids give empty bytes; an id outside the vocabulary is an error."""

    table = vocabulary(ranks).table

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks, table)
        for batch in batches:
            column = batch.column(ids).cast(pa.large_list(pa.int64()))
            column = column.fill_null([])
            first = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            values = column.values.fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b in words.pieces(first - first[0], words.PIECE_BYTES // 4):
                data, upto = vocab.decode(values[first[a] : first[b]])
                cut = upto[first[a : b + 1] - first[a]].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
                yield _put(batch.slice(a, b - a), out, kept)

    return docs.mapInArrow(decode, _with(docs, out, T.BinaryType()))
