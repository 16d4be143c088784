"""Token ids on disk: canonical length-limited Huffman codes from global counts, in independent blocks with bit-offset checkpoints.

A folder holds ``codebook`` (id, bits), ``blocks`` and ``parts`` (part, start). Blocks lie in the documents' order by (part, block); each is one binary record with its own header, so any of them
is decoded without the others, a document of it from its own first word, and any 64 ids of that from the checkpoint before them. Spark's writer carries the records, which gives the commit, the retries and remote file systems.
"""

from __future__ import annotations

import contextlib
import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texelmill.llm.words import pieces

#: Longest code in bits; more only where an alphabet needs more. A decoding table has two to this power entries.
MOST_BITS = 18
#: Ids must be below this; tables by id are this long at most.
MOST_IDS = 1 << 22
BLOCK, CHECKPOINT = 1 << 16, 64
#: Different segments of texts that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 600_000, 200
PIECE = 1 << 23
#: Bytes of codes in a range of documents, before it has as many as Spark's shuffles have partitions.
PART = 1 << 23

U = np.uint64

# ---- ids by a tokenizer file ---------------------------------------------------------------------------------------------

#: White space with what follows it. The pattern of byte-level tokenizers always cuts before white space that follows anything else, and nothing beyond a segment changes its ids. The four
#: separators are white space to this module but not to Unicode.
_SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_SIGNS = r"[!-&(-/:-@\[-`{-~]"
#: A pre-token or two: perhaps a blank, letters (that all versions of Unicode have), perhaps signs, none of which begins a contraction.
_WORD = re.compile(rf"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)({_SIGNS}*)")
_SIGN = re.compile(rf" ?{_SIGNS}+")
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A blank or a line's end beside white space, or white space at an end: what lies between them are then not segments. A zero would be taken for a cut.
_ODD = rf"[ \n]{_WHITE}|{_WHITE}[ \n]|^{_WHITE}|{_WHITE}$|\x00"


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next of those from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in seen else next(rest)) for b in range(256)}


@functools.lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # in a text the names of special tokens are text
    return found


class Encoder:
    """Ids of texts by the tokenizers library, which sees each different segment once while it is remembered.

    A blank and letters are one pre-token, and so are signs behind them; these go to the library's merges directly, all other segments to the library as they are.
    """

    def __init__(self, path: str):
        self.library, self.known = _tokenizer(path), {"": b""}
        self.long: list[str] = []  # segments to be forgotten
        self.merges, self.signs = self.library.model.tokenize, _byte_signs()
        self.blank = self.signs[0x20]

    def _spell(self, part: str) -> bytes:
        """Ids of one pre-token."""
        spelt = part.replace(" ", self.blank) if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
        return array("i", [t.id for t in self.merges(spelt)]).tobytes()

    def _ids(self, segment: str) -> bytes:
        if _SIGN.fullmatch(segment):
            return self._spell(segment)
        if segment[0] in "\n\t" and segment[1:] and not segment[1].isspace():
            return b"".join(map(self.known.__getitem__, self._learn([segment[0], segment[1:]])))
        if len(parts := _SEGMENT.findall(segment)) > 1:
            return b"".join(map(self.known.__getitem__, self._learn(parts)))
        return array("i", self.library.encode(segment, add_special_tokens=False).ids).tobytes()

    def _learn(self, segments: list[str]) -> list[str]:
        """The same segments, all of them known now."""
        known, spell, word_of = self.known, self._spell, _WORD.fullmatch
        for s in segments:
            if s in known:
                continue
            if m := word_of(s):
                word, signs = m.groups()
                if (ids := known.get(word)) is None:
                    ids = known[word] = spell(word)
                if signs:
                    if (more := known.get(signs)) is None:
                        more = known[signs] = spell(signs)
                    known[s] = ids + more
            else:
                known[s] = self._ids(s)
                if len(s) > LONGEST:
                    self.long.append(s)
        return segments

    def encode(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Per text its ids as 32-bit integers, then ``end``. Each different segment is looked up once, the rest is gathered."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        while self.long:
            self.known.pop(self.long.pop(), None)
        # a line's end between others is a pre-token of its own
        segments = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)), " ", "\0 "), "\n", "\0\n\0"), "\0")
        coded = pc.dictionary_encode(segments.flatten())
        ids = list(map(self.known.__getitem__, self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())))
        flat = np.frombuffer(b"".join(ids), np.int32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy()
        count = size[code]
        upto = np.concatenate(([0], np.cumsum(count)))
        gathered = flat[np.arange(upto[-1]) + np.repeat((np.cumsum(size) - size)[code] - upto[:-1], count)].tobytes()
        cuts = (4 * upto[np.concatenate(([0], np.cumsum(pc.list_value_length(segments).to_numpy())))]).tolist()
        plain = iter(zip(cuts, cuts[1:]))
        out = []
        for row, strange in enumerate(odd.tolist()):
            if strange:
                out.append(b"".join([*map(self.known.__getitem__, self._learn(_SEGMENT.findall(texts[row].as_py()))), end]))
            else:
                a, b = next(plain)
                out.append(gathered[a:b] + end)
        return out


def _packed(ids: bytes) -> bytes:
    values = np.frombuffer(ids, np.int32)
    return b"\2" + values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else b"\4" + values.astype("<i4").tobytes()


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", end_id: int | None = None, counts: str | None = None, packed: bool = False) -> DataFrame:
    """The same rows plus ``out``, array<int>: the ids of the whole text by the byte-level tokenizer file, without special tokens, then ``end_id`` if given.

    With ``packed``, ``out`` is binary, which Spark writes and reads without touching each id: the bytes of an id (2 or 4, as the text needs), then the ids, little-endian. :func:`write_ids` and :func:`count_ids` take both.
    ``counts``, if named, is binary: on one row of each piece how often its ids occur, for :func:`count_ids`, null on the others. A null text is empty. Columns of the new names are replaced, all others are kept. No shuffle; a worker holds a piece of PIECE bytes of texts, or one longer text, and REMEMBERED segments.
    """
    own = [f for f in docs.schema.fields if f.name not in (out, counts)]
    end = b"" if end_id is None else np.array([end_id], np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            texts = batch.column(text).cast(pa.string()).fill_null("")
            at = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))).astype(np.int64)
            for a, b in pieces(at, PIECE):
                ids = encoder.encode(texts.slice(a, b - a), end)
                first = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                more = {out: pa.array(list(map(_packed, ids)), pa.binary()) if packed else pa.ListArray.from_arrays(first, pa.array(flat))}
                if counts:
                    seen = np.bincount(flat)
                    used = np.flatnonzero(seen)
                    more[counts] = pa.array([np.stack((used, seen[used])).astype("<i8").tobytes(), *[None] * (b - a - 1)], pa.binary())
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in own], *more.values()], [*[f.name for f in own], *more])

    more = [T.StructField(out, T.BinaryType() if packed else T.ArrayType(T.IntegerType())), *([T.StructField(counts, T.BinaryType())] if counts else [])]
    return docs.mapInArrow(run, T.StructType([*own, *more]))


# ---- codes ---------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Bits of each symbol's code, none above ``most`` and the total least under that; 0 for symbols without a count. Package-merge, a level a bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    most = max(most, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, kinds = weight, [np.ones(len(weight), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        by = np.argsort(both, kind="stable")
        level = both[by]
        kinds.append(by < len(weight))
    take, lengths = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for single in reversed(kinds):
        leaves = int(single[:take].sum())  # the lightest ones
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: codes of one length are consecutive numbers in the order of the symbols, after all shorter ones."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        self.most = most = int(self.lengths.max(initial=1))
        wide = np.int64(1) << (most - self.lengths[order])  # table entries that begin with the code
        first = np.cumsum(wide) - wide
        self.codes = np.zeros(len(lengths), U)
        self.codes[order] = (first >> (most - self.lengths[order])).astype(U)
        self.symbol, self.bits = np.zeros(1 << most, np.int32), np.zeros(1 << most, np.int64)
        filled = int(wide.sum())
        self.symbol[:filled], self.bits[:filled] = np.repeat(order, wide), np.repeat(self.lengths[order], wide)

    def pack(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bits of consecutive documents' ids, in 8-byte words, each document from a word of its own; the first word of each document, and one more; and where each id begins."""
        bits = self.lengths[ids]
        if not bits.all():
            raise ValueError("an id that was not counted")
        upto = np.concatenate(([0], np.cumsum(bits)))
        word_of = np.concatenate(([0], np.cumsum((np.diff(upto[first]) + 63) >> 6)))
        out = np.zeros(word_of[-1], U)
        if not len(ids):
            return out, word_of, upto[:-1]
        begin = upto[:-1] + np.repeat(64 * word_of[:-1] - upto[first[:-1]], np.diff(first))
        word, over = begin >> 6, (begin & 63) + bits - 64  # bits beyond the word
        code = self.codes[ids]
        here = np.where(over > 0, code >> np.maximum(over, 0).astype(U), code << np.maximum(-over, 0).astype(U))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(here, starts)
        cut = np.flatnonzero(over > 0)  # one a word at most
        out[word[cut] + 1] |= code[cut] << (64 - over[cut]).astype(U)
        return out, word_of, begin

    def unpack(self, data: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of documents of these sizes, from the places where every CHECKPOINT-th id of each begins. All stretches between checkpoints are read side by side, an id of each a step."""
        words = np.concatenate((np.frombuffer(data, ">u8").astype(U), np.zeros(2, U)))
        at = checkpoints.astype(np.int64)
        stretches = -(-sizes // CHECKPOINT)
        long = np.full(len(at), CHECKPOINT, np.int64)
        ends = np.cumsum(stretches)[sizes > 0] - 1
        long[ends] = (sizes[sizes > 0] - 1) % CHECKPOINT + 1
        out = np.empty((len(at), CHECKPOINT), np.int32)
        for k in range(int(long.max(initial=0))):
            w, s = np.minimum(at >> 6, len(words) - 2), (at & 63).astype(U)  # a stretch may be over before others
            top = ((words[w] << s) | (words[w + 1] >> U(1) >> (U(63) - s))) >> U(64 - self.most)
            out[:, k] = self.symbol[top]
            at += self.bits[top]
        return out[np.arange(CHECKPOINT) < long[:, None]]


# ---- files ---------------------------------------------------------------------------------------------------------------

_BLOCKS = "part int, block long, start long, n int, first_doc long, continues boolean, goes_on boolean, docs array<{key}>, sizes array<int>, checkpoints array<int>, bits binary"
_PIECES = "doc {key}, row long, piece long, pieces long, n int, checkpoints array<int>, bits binary"


#: Documents in an Arrow batch: they are thousands of ids long.
ROWS = 500


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """For the jobs run inside, ROWS rows to an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(ROWS, int(before)) if int(before) > 0 else ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column or one of packed ids, null counting as empty, and the first of each row."""
    if pa.types.is_binary(column.type):
        rows = [np.frombuffer(x, "<u2" if x[0] == 2 else "<i4", offset=1) if x else np.zeros(0, "<u2") for x in column.to_pylist()]
        return np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
    column = column.cast(pa.list_(pa.int32()))
    column = column.fill_null([]) if column.null_count else column
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), first


def count_ids(docs: DataFrame, ids: str = "ids", counts: str | None = None) -> np.ndarray:
    """How often each id occurs: counted per task (from the column ``counts`` of :func:`encode_documents` where there is one), added up by Spark; at most MOST_IDS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if counts:
                told = [np.frombuffer(x, "<i8").reshape(2, -1) for x in batch.column(counts).to_pylist()]
                values, weights = np.concatenate(told, axis=1) if told else (np.zeros(0, np.int64), None)
            else:
                (values, _), weights = _flat(batch.column(ids)), None
            if len(values):
                if values.min() < 0 or values.max() >= MOST_IDS:
                    raise ValueError(f"ids must be 0..{MOST_IDS - 1}")
                now = np.bincount(values, weights, len(total)).astype(np.int64)  # sums of doubles, exact below 2 ** 53
                now[: len(total)] += total
                total = now
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    given = docs.select(counts).where(F.col(counts).isNotNull()) if counts else docs.select(ids)
    rows = given.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """The least (doc, row) of every range but the first: at most ``parts`` ranges, and no more than Spark's shuffles have partitions, of about as many rows each."""
    parts = max(1, min(parts, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    least = keys.repartitionByRange(parts, "doc", "row").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc", "row")).alias("least")).collect()
    return [tuple(r.least) for r in sorted(least, key=lambda r: r.part)][1:]


def _range_of(bounds: list[tuple], key: T.DataType) -> Column:
    """The number of the range of (doc, row), found by halving in one array of the bounds; null first."""
    if not bounds:
        return F.lit(0)
    least = F.array(*[F.struct(F.lit(doc).cast(key).alias("doc"), F.lit(row).cast("long").alias("row")) for doc, row in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(bounds)) & (F.struct("doc", "row") >= F.get(least, at + step - 1)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def write_ids(docs: DataFrame, folder: str, order: str = "doc_id", ids: str = "ids", counts: str | None = None) -> None:
    """Write the ids of all rows to ``folder`` in ascending ``order``, null first, ties in the order of the table; equal rows are documents of their own.

    Null ids are a document without any. ``docs`` is read three times (counts, range bounds from ``order`` alone, blocks), so pass a written table. One shuffle of the ids, into ranges of (order, row) that a hot key
    can't fill; a task holds the documents of a block, or one longer document. A block holds
    whole documents of at most BLOCK ids together, or one stretch of a longer one. A table without rows makes a folder without blocks.
    """
    spark = docs.sparkSession
    with _small_batches(spark):
        counted = count_ids(docs, ids, counts)
    lengths = code_lengths(counted)
    used = np.flatnonzero(lengths)
    book = pa.table([pa.array(used, pa.int32()), pa.array(lengths[used], pa.int32())], names=["id", "bits"])
    spark.createDataFrame(book).coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    key = docs.schema[order].dataType
    rows = docs.select(F.col(order).alias("doc"), F.col(ids).alias("ids"), F.monotonically_increasing_id().alias("row"))
    pieces_schema = T._parse_datatype_string(_PIECES.format(key=key.simpleString()))
    schema = T._parse_datatype_string(_BLOCKS.format(key=key.simpleString()))

    bounds = _bounds(rows.select("doc", "row"), -(-int(lengths.astype(np.int64) @ counted) // (8 * PART))) if isinstance(key, (T.IntegralType, T.StringType)) else None

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            values, first = _flat(batch.column("ids"))
            # documents in pieces of at most BLOCK ids; one without ids is a piece too
            pieces_ = np.maximum(-(-np.diff(first) // BLOCK), 1)
            owner = np.repeat(np.arange(len(pieces_)), pieces_)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces_) - pieces_, pieces_)
            begin = np.append(first[owner] + piece * BLOCK, first[-1])
            packed, word_of, at = code.pack(values, begin)
            packed, cuts = packed.byteswap().tobytes(), (8 * word_of).tolist()
            marks = [(at[a:b:CHECKPOINT] - 64 * w).astype(np.int32) for a, b, w in zip(begin[:-1].tolist(), begin[1:].tolist(), word_of.tolist())]
            counts = np.concatenate(([0], np.cumsum([len(m) for m in marks]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(counts, pa.array(np.concatenate([np.zeros(0, np.int32), *marks]), pa.int32()))
            columns = [batch.column("doc").take(pa.array(owner)), batch.column("row").take(pa.array(owner)), pa.array(piece), pa.array(pieces_[owner]), pa.array(np.diff(begin), pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], [f.name for f in pieces_schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [f.name for f in schema.fields]
        kind = pa.null()
        held: list[tuple] = []  # pieces of the next block
        size = block = start = first_doc = 0

        def record() -> pa.RecordBatch:
            nonlocal held, size, block, start, first_doc
            docs_, piece, pieces_, n, marks, bits = zip(*held)
            continues, goes_on = piece[0] > 0, piece[-1] + 1 < pieces_[-1]
            before = np.cumsum([0, *(8 * len(b) for b in bits[:-1])])
            shifted = np.concatenate([np.array(m, np.int64) + w for m, w in zip(marks, before.tolist())])
            row = [part, block, start, sum(n), first_doc, continues, goes_on, list(docs_), list(n), shifted, b"".join(bits)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            block, start, first_doc = block + 1, start + sum(n), first_doc + len(docs_) - goes_on
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            kind = batch.schema.field("doc").type
            for one in zip(*(batch.column(c).to_pylist() for c in ("doc", "piece", "pieces", "n", "checkpoints", "bits"))):
                # pieces of a longer document are blocks of their own
                if held and (size + one[3] > BLOCK or one[2] > 1 or held[-1][2] > 1):
                    yield record()
                held.append(one)
                size += one[3]
        if held:
            yield record()

    with _small_batches(spark):
        small = rows.mapInArrow(shrink, pieces_schema)
        # Spark would find the ranges of coded pieces by coding all of them once more
        dealt = small.repartitionByRange("doc", "row") if bounds is None else small.repartitionById(len(bounds) + 1, _range_of(bounds, key))
        ranged = dealt.sortWithinPartitions("doc", "row", "piece").drop("row")
        ranged.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/blocks")
    # one row per range partition
    sizes = sorted((r.part, r.n) for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).tolist()
    parts = [(p, s) for (p, _), s in zip(sizes, starts)]
    spark.createDataFrame(parts, "part int, start long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")


def _read(spark: SparkSession, folder: str, finish, schema: str) -> DataFrame:
    """Documents of a folder: (doc, start) and what ``finish`` makes of (ids of several documents, first id of each), of the columns ``schema``.

    The codebook and one number per range partition come to the driver. Blocks are decoded where they are read; only documents longer than a block are put together by a shuffle.
    """
    book = spark.read.parquet(f"{folder}/codebook").toArrow()
    starts = {r.part: r.start for r in spark.read.parquet(f"{folder}/parts").collect()}
    lengths = np.zeros(max(book["id"].to_pylist(), default=-1) + 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["bits"].to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks")
    key = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                first = np.concatenate(([0], row["sizes"].values.to_numpy())).cumsum()
                ids = code.unpack(row["bits"].as_py(), row["checkpoints"].values.to_numpy(), np.diff(first))
                docs, part, block = row["docs"].values, row["part"].as_py(), row["block"].as_py()
                numbers = [np.full(len(docs), part, np.int32), row["first_doc"].as_py() + np.arange(len(docs)), np.full(len(docs), block, np.int64)]
                begin = starts[part] + row["start"].as_py() + first[:-1]
                made = make(ids, first)
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), docs, pa.array(begin, pa.int64()), *made.values()], ["part", "doc_no", "block", "doc", "start", *made])

    head = f"part int, doc_no long, block long, doc {key}, start long"
    cut = F.col("continues") | F.col("goes_on")
    whole = blocks.where(~cut).mapInArrow(lambda b: run(b, finish), f"{head}, {schema}").drop("part", "doc_no", "block")
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda x: x["ids"]))
    parts = blocks.where(cut).mapInArrow(lambda b: run(b, _as_lists), f"{head}, ids array<int>")
    long = parts.groupBy("part", "doc_no").agg(F.first("doc").alias("doc"), F.min("start").alias("start"), ordered.alias("ids")).drop("part", "doc_no")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = finish(*_flat(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("start"), *made.values()], ["doc", "start", *made])

    return whole.unionByName(long if finish is _as_lists else long.mapInArrow(again, f"doc {key}, start long, {schema}"))


def _as_lists(ids: np.ndarray, first: np.ndarray) -> dict[str, pa.Array]:
    return {"ids": pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids, pa.int32()))}


def _as_checksums(ids: np.ndarray, first: np.ndarray) -> dict[str, pa.Array]:
    raw = memoryview(ids.astype("<i4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return {"n_tokens": pa.array(np.diff(first), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}


def read_ids(spark: SparkSession, folder: str, order: str = "doc_id", out: str = "ids") -> DataFrame:
    """(``order``, start, ``out``) of every document of a folder written by :func:`write_ids`: ``start`` counts the ids of all documents before it."""
    return _read(spark, folder, _as_lists, "ids array<int>").select(F.col("doc").alias(order), "start", F.col("ids").alias(out))


def read_checksums(spark: SparkSession, folder: str, order: str = "doc_id") -> DataFrame:
    """(``order``, start, n_tokens, ids_crc32) of every document, from the decoded ids: the checksum is of the ids as little-endian 32-bit integers."""
    return _read(spark, folder, _as_checksums, "n_tokens long, ids_crc32 long").select(F.col("doc").alias(order), "start", "n_tokens", "ids_crc32")
