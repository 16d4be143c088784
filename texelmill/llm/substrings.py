"""Substring dedup: word windows that also start in an earlier document are removed, found through a count-min prefilter and an exact second pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texelmill.llm import words
from texelmill.llm.words import U
from texelmill.session import cut_lineage

WINDOW = 50
#: A window is counted under the least hash of its grams of this many words; neighbours mostly share it, so there are far fewer anchors than windows.
ANCHOR = 20
#: Sketch: rows, and cells per counted anchor in each row.
DEPTH, CELLS = 2, 16
#: Windows that a task compares among themselves before it hands on one document for each.
CHUNK = 1 << 20


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    least, span = values, 1
    while span * 2 <= n:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    return np.minimum(least[: len(values) - n + 1], least[n - span :][: len(values) - n + 1])


def window_anchors(own: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of consecutive texts, and the first window of each text."""
    grams, at = own.grams(ANCHOR, 31)
    reach = WINDOW - ANCHOR + 1
    size = np.maximum(np.diff(at) - (reach - 1), 0)
    first = np.concatenate(([0], np.cumsum(size)))
    if not first[-1]:
        return np.zeros(0, U), first
    return sliding_least(grams, reach)[np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], size)], first


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows are known by their id and a hash of their text, so rows that share an id keep apart."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    return rows.select("doc", F.xxhash64("text").alias("version"), "text")


def anchors(rows: DataFrame) -> DataFrame:
    """(doc, version, anchor): the different anchors of each text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.text_buffer(batch.column("text"))
            for a, b in words.pieces(at):
                found, first = window_anchors(words.Words(data[at[a] : at[b]], at[a : b + 1] - at[a]))
                own = [np.unique(found[first[i] : first[i + 1]]) for i in range(b - a)]
                rows = pa.array(np.repeat(np.arange(a, b), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(rows), batch.column("version").take(rows), pa.array(words.signed(np.concatenate(own)))], ["doc", "version", "anchor"])

    schema = T.StructType([rows.schema["doc"], rows.schema["version"], T.StructField("anchor", T.LongType())])
    return rows.mapInArrow(run, schema)


def estimated_repeated(found: DataFrame) -> DataFrame:
    """Those rows of ``found`` whose anchor a count-min sketch has seen more than once.

    The sketch has DEPTH rows of CELLS cells per anchor, so it grows with the input; partitions add up their cells before they are merged by a shuffle. A cell counts all that fall
    into it, so no count is too low and no repeated anchor is lost; about 1 / CELLS ** DEPTH of the others come along.
    """
    width = 1 << max(10, (CELLS * max(found.count(), 1)).bit_length())
    cell = lambda row: F.xxhash64("anchor", F.lit(row)).bitwiseAND(F.lit(width - 1))
    cells = found.select(F.explode(F.array(*[F.struct(F.lit(r).alias("row"), cell(r).alias("cell")) for r in range(DEPTH)])).alias("c")).select("c.*")
    repeated = cut_lineage(cells.groupBy("row", "cell").agg(F.count("*").alias("n")).where("n > 1").select("row", "cell"))
    for r in range(DEPTH):
        found = found.withColumn("cell", cell(r)).join(repeated.where(F.col("row") == r).select("cell"), "cell", "left_semi").drop("cell")
    return found


def _suspects(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Windows under suspected anchors, each once per chunk: (anchor, hash, doc, version, place, n, gone).

    Within a chunk of CHUNK windows only the smallest document of each window is left to be compared with other chunks; the others are known to go and are handed on as runs of
    n windows (gone = true; anchor and hash then only spread the rows).
    """
    names = ["anchor", "hash", "doc", "version", "place", "n", "gone"]

    def decide(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, hashes, row, place = (np.concatenate(c) for c in zip(*[h[:4] for h in held]))
        doc = np.concatenate([h[4] for h in held])
        version = np.concatenate([h[5] for h in held])
        order = np.lexsort((place, version[row], doc[row], anchor, hashes))
        anchor, hashes, row, place = anchor[order], hashes[order], row[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (anchor[1:] != anchor[:-1])
        least = doc[row[new]][np.cumsum(new) - 1]
        gone = doc[row] != least
        kept = ~gone
        yield batch_of(anchor[kept], hashes[kept], doc[row[kept]], version[row[kept]], place[kept], np.ones(kept.sum(), np.int64), False)
        row, place = row[gone], place[gone]
        if len(row):
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            begin = np.flatnonzero(new)
            spread = words.mix(place[begin].astype(U), 5) ^ words.mix(version[row[begin]].astype(U), 6)
            yield batch_of(spread, spread, doc[row[begin]], version[row[begin]], place[begin], np.diff(np.append(begin, len(row))), True)

    def batch_of(anchor, hashes, doc, version, place, n, gone) -> pa.RecordBatch:
        columns = [words.signed(anchor), words.signed(hashes), doc, version, place.astype(np.int64), n.astype(np.int64), np.full(len(n), gone)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0
        for batch in batches:
            data, at = words.text_buffer(batch.column("text"))
            doc = batch.column("doc").cast(pa.int64()).to_numpy(zero_copy_only=False)
            version = batch.column("version").to_numpy(zero_copy_only=False)
            wanted = batch.column("anchors")
            for a, b in words.pieces(at):
                own = words.Words(data[at[a] : at[b]], at[a : b + 1] - at[a])
                found, first = window_anchors(own)
                hashes, _ = own.grams(WINDOW, 32)
                parts = []
                for i in range(b - a):
                    mine = words.signed(found[first[i] : first[i + 1]])
                    parts.append(np.flatnonzero(np.isin(mine, wanted[a + i].values.to_numpy(zero_copy_only=False))))
                row = np.repeat(np.arange(b - a), [len(p) for p in parts])
                place = np.concatenate(parts)
                at_all = first[row] + place
                held.append((found[at_all], hashes[at_all], row + base, place, doc[a:b], version[a:b]))
                base, size = base + (b - a), size + len(row)
                if size >= CHUNK:
                    yield from decide(held)
                    held, size, base = [], 0, 0
        if size:
            yield from decide(held)

    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()))])
    return rows.mapInArrow(run, schema)


def _strip(rows: DataFrame, out: list[str]) -> DataFrame:
    """``text`` to its kept words joined by one space; counts added. ``runs`` names the windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.text_buffer(batch.column("text"))
            runs = batch.column("runs")
            for a, b in words.pieces(at, 2 * words.PIECE_BYTES):
                raw, own_at = data[at[a] : at[b]], at[a : b + 1] - at[a]
                own = words.Words(raw, own_at)
                covered = np.zeros(len(own.start) + 1, np.int64)
                for i in range(a, b):
                    if runs[i].is_valid:
                        place, n = (runs[i].values.field(k).to_numpy(zero_copy_only=False) + own.at[i - a] for k in (0, 1))
                        np.add.at(covered, place, 1)
                        np.add.at(covered, place + (n - own.at[i - a]) + WINDOW - 1, -1)
                keep = np.cumsum(covered)[:-1] == 0
                kept = np.flatnonzero(keep)
                before = np.searchsorted(kept, own.at)  # kept words ahead of each text
                begin, end = own.start[kept], own.end[kept].copy()
                glue = np.ones(len(kept), bool)
                glue[before[1:][np.diff(before) > 0] - 1] = False  # the last of a text takes no space
                step = np.zeros(len(raw) + 2, np.int8)
                step[begin] += 1
                step[end + glue] -= 1
                raw = raw.copy()
                raw[end[glue]] = 0x20
                data_out = raw[np.cumsum(step[: len(raw)]) > 0]
                size = np.concatenate(([0], np.cumsum(end + glue - begin)))
                cut = size[before].astype(np.int64)
                text = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data_out))]).cast(pa.string())
                words_in = np.diff(own.at)
                part = batch.slice(a, b - a)
                columns = {n: part.column(n) for n in part.schema.names if n != "runs"} | {"text": text, "n_words": pa.array(words_in), "n_removed": pa.array(words_in - np.diff(before))}
                yield pa.RecordBatch.from_arrays([columns[n] for n in out], out)

    fields = [f for f in rows.schema.fields if f.name in out and f.name not in ("n_words", "n_removed")]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(run, schema)


def remove_repeated_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, n_words, n_removed), one row per input row: the kept words joined by one space.

    A word goes when a window of WINDOW consecutive words covers it whose word sequence also starts in a document with a smaller integer ``doc``; windows are those of the input. Texts of
    fewer words lose nothing. A null text has no words and gives an empty one. A row without ``doc`` loses nothing and takes nothing from others; rows with the same ``doc`` take nothing from each other.
    No window of a hot passage meets all others in one task: each task first settles its own, so a passage makes one row per task and window.
    """
    rows = _rows(docs, doc, text)
    marked = estimated_repeated(cut_lineage(anchors(rows)))
    wanted = marked.groupBy("doc", "version").agg(F.collect_set("anchor").alias("anchors"))
    suspects = _suspects(rows.join(wanted, ["doc", "version"]).select("doc", "version", "text", "anchors"), rows.schema["doc"].dataType)
    least = F.min(F.when(~F.col("gone"), F.col("doc"))).over(Window.partitionBy("anchor", "hash"))
    gone = suspects.withColumn("least", least).where(F.col("gone") | (F.col("doc") > F.col("least")))
    runs = gone.groupBy("doc", "version").agg(F.collect_list(F.struct("place", "n")).alias("runs"))
    runs = runs.select(F.col("doc").cast(rows.schema["doc"].dataType).alias("doc"), "version", "runs")
    out = ["doc", "text", "n_words", "n_removed"]
    done = _strip(rows.join(runs, ["doc", "version"], "left").select("doc", "text", "runs"), out)
    none: Column = F.lit(None).cast("array<struct<place:bigint,n:bigint>>")
    rest = docs.where(F.col(doc).isNull() | F.col(text).isNull())
    rest = rest.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), none.alias("runs"))
    return done.unionByName(_strip(rest, out)).withColumnsRenamed({"doc": doc, "text": text})
