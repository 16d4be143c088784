"""Periodic runs of words: stretches that repeat with a smallest period, found over tiles of every scale and stitched by document and period.

For the periods S..2S-1 of an octave a document is cut into blocks of S words. With period p, a stretch of length L holds L - p places whose word is met again p words on; in a run
these are at least 2S in a row, so they cover a whole block. A tile is one block with S words before it and 3S behind: it is solved on its own, by a Z-function forward and one
backward from the block's first word, and tells a fragment of that row of places. Fragments of one document and period that touch are one run. Neighbouring blocks' fragments always
touch within a run, so the union of the fragments is the whole row of places.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texelmill.llm.words import U
from texelmill.session import cut_lineage

#: A run has at least this many words and at least this many periods.
LEAST_LENGTH, LEAST_TIMES = 24, 3
#: Words of a block of the first octave, which takes all periods below 2 * BLOCK. A run of such a period has LEAST_LENGTH - period places or more, two blocks of them.
BLOCK = 8
#: Tiles of one octave that are merged before they leave a task; beyond that their fragments meet in the shuffle.
TILES = 1024

_ODD = U(0x9E3779B97F4A7C15)


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal where the words are."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place below ``upto`` the length of the longest common prefix of ``s`` and of ``s`` from there."""
    n = len(s)
    z, a, b = [0] * upto, 0, 0
    if upto:
        z[0] = n
    for i in range(1, upto):
        k = min(z[i - a], b - i) if i < b else 0
        if i + k >= b:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            a, b = i, i + k
        z[i] = k
    return z


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(block size, first word of the block, periods that may fit) of every tile that can hold a fragment, octave by octave.

    A block of a run recurs as a whole one period on. Blocks are compared by hashes of their words; equal hashes only choose tiles, words decide in :func:`solve`.
    """
    n, size = len(ids), BLOCK
    if n < LEAST_LENGTH:
        return
    gram, step = (ids.astype(U) + U(1)) * _ODD, 1
    gram ^= gram >> U(29)
    while step < size:
        gram, step = _wider(gram, step), step * 2
    low = 1
    while LEAST_TIMES * low <= n and len(gram):
        rows = np.zeros((len(gram) // size + 2) * size, U)
        rows[: len(gram)] = gram
        rows = rows.reshape(-1, size)
        same = rows[1:] == rows[:-1, :1]
        if low == 1:
            same = np.concatenate((rows[:-1, 1:] == rows[:-1, :1], same), axis=1)
        block, k = np.nonzero(same)
        fits = (LEAST_TIMES * (k + low) <= n) & (block * size + k + low + size <= n)
        block, period = block[fits], k[fits] + low
        if len(block):
            cut = np.flatnonzero(np.diff(block)) + 1
            for b, p in zip(block[np.concatenate(([0], cut))].tolist(), np.split(period, cut)):
                yield size, b * size, p.tolist()
        low = 2 * size
        gram, size = _wider(gram, size), low


def _wider(gram: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice as many words."""
    return gram[:-size] * U(2 * size + 1) * _ODD + gram[size:] if len(gram) > size else gram[:0]


@functools.lru_cache(1 << 16)
def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def solve(ids: np.ndarray, size: int, at: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, first place, place behind the last) of a tile: places around its block whose words recur one period on, no further than ``size`` beyond the block.

    Periods whose first words are themselves a power are left out: the stretch belongs to a smaller period.
    """
    most = periods[-1] + 1
    ahead = z_function(ids[at : at + 4 * size].tolist(), most)
    if any(ahead[q] + q >= most + size for q in range(1, size if size > BLOCK else 1)):
        return  # the whole tile has a period below the octave's, so all that fit are powers of it
    good = [p for p in periods if ahead[p] >= size and all(ahead[p // r] < p - p // r for r in _prime_factors(p))]
    if not good:
        return
    first, end = max(0, at - size), at + good[-1]
    back = ids[first:at][::-1].tolist()
    behind = z_function([*back, -1, *ids[first:end][::-1].tolist()], len(back) + 1 + good[-1])
    for p in good:
        yield p, at - min(behind[len(back) + 1 + end - at - p], len(back)), at + min(ahead[p], 2 * size)


def fragments(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Fragments of a document; those of one period that touch within TILES tiles of an octave are one."""
    out: list[tuple[int, int, int]] = []
    open_: dict[int, tuple[int, int]] = {}
    since = (0, 0)
    for size, at, periods in tiles(ids):
        if since[0] != size or at - since[1] >= TILES * size:
            out += [(p, *x) for p, x in open_.items()]
            open_, since = {}, (size, at)
        for p, a, b in solve(ids, size, at, periods):
            if p in open_ and a <= open_[p][1]:
                open_[p] = (min(a, open_[p][0]), max(b, open_[p][1]))
            else:
                if p in open_:
                    out.append((p, *open_[p]))
                open_[p] = (a, b)
    return out + [(p, *x) for p, x in open_.items()]


_FOUND = "array<struct<period:long,first:long,upto:long>>"
_RUNS = "array<struct<start:long,length:long,period:long>>"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("upto", pa.int64())]))
    for batch in batches:
        count, found, plain = [], [], []
        for text in batch.column("_text").cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # the ASCII white space: blank, tab to carriage return
            count.append(len(words))
            plain.append(b" ".join(words).decode())
            found.append([{"period": p, "first": a, "upto": b} for p, a, b in fragments(numbered(words))] if len(words) >= LEAST_LENGTH else [])
        kept = [n for n in batch.schema.names if n != "_text"]
        columns = [*[batch.column(n) for n in kept], pa.array(plain, pa.string()), pa.array(count, pa.int64()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "_plain", "_words", "_found"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("_plain"), batch.column("_runs").to_pylist()):
            words = text.as_py().split(" ")
            gone = np.zeros(len(words) + 1, np.int64)
            for run in runs:
                gone[run["start"] + run["period"]] += 1
                gone[run["start"] + run["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            texts.append(" ".join([words[i] for i in kept.tolist()]))
        yield batch.set_column(batch.schema.get_field_index("_plain"), "_plain", pa.array(texts, pa.string()))


def stitch(found: DataFrame, by: str) -> DataFrame:
    """Runs of fragments (``by``, period, first, upto): (``by``, start, length, period), fragments that touch being one."""
    w = Window.partitionBy(by, "period").orderBy("first", "upto")
    before = F.max("upto").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = marked.groupBy(by, "period", "_island").agg(F.min("first").alias("start"), F.max("upto").alias("_upto"))
    length = F.col("_upto") - F.col("start") + F.col("period")
    return whole.select(by, "start", length.alias("length"), "period").where((F.col("length") >= LEAST_LENGTH) & (F.col("length") >= LEAST_TIMES * F.col("period")))


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with ``text`` collapsed: its words joined by one space, without what a run has after its first period. Plus ``n_words`` (before), and ``runs``,
    array<struct<start,length,period>> by start, then period.

    A word is a longest run of characters other than space and tab..carriage return. A run is a stretch with smallest period q, of 24 words and 3 periods at least, that no neighbouring word
    extends. Null and empty texts have no words and become empty; null ids, repeated rows and ties are rows of their own, since rows are told apart by a number given here; the columns
    ``n_words`` and ``runs`` of the input are replaced, all others kept; an empty table gives an empty one.

    Tiles are made and solved where a document is read, so only fragments are shuffled, by (document, period), and of the texts only those that have one. A task holds one Arrow batch of texts and some 60
    bytes a word of the longest text.
    """
    own = [c for c in docs.columns if c not in (text, "n_words", "runs")]
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(own)]
    rows = docs.select(*kept, F.col(text).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    more = [T.StructField("_plain", T.StringType()), T.StructField("_words", T.LongType()), T.StructField("_found", T._parse_datatype_string(_FOUND))]
    searched = cut_lineage(rows.mapInArrow(_search, T.StructType([*fields, *more])).withColumn("_row", F.monotonically_increasing_id()))

    some = searched.where(F.size("_found") > 0)
    found = some.select("_row", F.explode("_found").alias("f")).select("_row", "f.*")
    runs = stitch(found, "_row").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("_runs"))
    none = F.lit(None).cast(_RUNS)
    joined = some.drop("_found").join(runs, "_row", "left").withColumn("_runs", F.coalesce("_runs", F.array().cast(_RUNS)))
    names = [f.name for f in fields]
    joined = joined.select(*names, "_plain", "_words", "_runs")
    done = joined.mapInArrow(_collapse, joined.schema)
    rest = searched.where(F.size("_found") == 0).select(*names, "_plain", "_words", F.coalesce(none, F.array().cast(_RUNS)).alias("_runs"))
    out = done.unionByName(rest)
    columns = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(own)} | {text: F.col("_plain").alias(text)}
    return out.select(*[columns[c] for c in docs.columns if c in columns], F.col("_words").alias("n_words"), F.col("_runs").alias("runs"))
