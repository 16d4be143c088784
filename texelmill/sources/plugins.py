"""Plugin files: string sub-records out, same-length patches in."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: tags, sub-record head (tag + u16 size) and the header window ---------------------------------
FILE_TAG, TEXT_TAG, HEADER_TAGS = b"TES4", b"EDID", (b"CNAM", b"SNAM")
HEAD_BYTES = 6
HEADER_WINDOW = 20000
# -------------------------------------------------------------------------------------------------------------------

RECORD_SCHEMA = "path string, rec_offset bigint, tag string, size int, text string"
_ARROW = pa.schema([("path", pa.string()), ("rec_offset", pa.int64()), ("tag", pa.string()), ("size", pa.int32()), ("text", pa.string())])


def _record(data: bytes, at: int) -> tuple[int, str] | None:
    """Size and text of the sub-record at ``at``; None when it runs over the end."""
    if at + HEAD_BYTES > len(data):
        return None
    (size,) = struct.unpack_from("<H", data, at + 4)
    if at + HEAD_BYTES + size > len(data):
        return None
    return size, data[at + HEAD_BYTES : at + HEAD_BYTES + size].rstrip(b"\x00").decode("utf-8", errors="ignore")


def _texts(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    at = data.find(TEXT_TAG)
    while at >= 0 and (found := _record(data, at)) is not None:
        yield at, TEXT_TAG.decode(), *found
        at = data.find(TEXT_TAG, at + HEAD_BYTES + found[0])


def _headers(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    start = data.find(FILE_TAG)
    for tag in HEADER_TAGS if start >= 0 else ():
        at = data.find(tag, start, start + HEADER_WINDOW)
        while at >= 0:
            if (found := _record(data, at)) is not None:
                yield at, tag.decode(), *found
            at = data.find(tag, at + 4, start + HEADER_WINDOW)


def _scan(files: DataFrame, walk) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [dict(zip(_ARROW.names, (path, *r))) for r in walk(content or b"")]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(read, RECORD_SCHEMA)


def plugin_strings(files: DataFrame) -> DataFrame:
    """Every EDID sub-record of ``path, content``, jumping past payloads and stopping at an overrun."""
    return _scan(files, _texts)


def plugin_header(files: DataFrame) -> DataFrame:
    """CNAM and SNAM candidates at or after the file tag, inside its first 20 000 bytes."""
    return _scan(files, _headers)


def patch_files(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Overwrite payloads in place. ``patches``: path, rec_offset, payload; files without patches pass through.

    Patches are gathered per file (never more bytes than the file itself) and joined once.
    """
    change = F.sort_array(F.collect_list(F.struct(F.col("rec_offset").alias("at"), "payload"))).alias("patches")
    joined = files.select("path", "content").join(patches.where(F.col("payload").isNotNull()).groupBy("path").agg(change), "path", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = bytearray(row["content"])
                for p in row["patches"] or ():
                    at = p["at"] + HEAD_BYTES
                    data[at : at + len(p["payload"])] = p["payload"]
                out.append({"path": row["path"], "content": bytes(data)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return joined.mapInArrow(write, "path string, content binary")
