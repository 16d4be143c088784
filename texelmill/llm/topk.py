"""Exact top-k search by inner product with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texelmill.session import cut_lineage

#: Vectors of one forward-index block, blocks of one chunk (what a task searches at once), queries of one group.
BLOCK, CHUNK_BLOCKS, GROUP = 64, 64, 256
#: Groups and chunks in one cell of the grid of both.
CELL = 16
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Components whose products add up below this are multiplied as doubles without loss.
EXACT = 2**53


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v array<double>): rows with an id and a vector whose components are all there and finite."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of list rows as int64, short rows padded with 0; components beyond 2**62 stop there."""
    column = column.cast(pa.large_list(pa.float64()))
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.clip(np.floor(column.values.to_numpy(zero_copy_only=False) * scale), -(2.0**62), 2.0**62).astype(np.int64)
    size = np.diff(at)
    out = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(column)), size), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = values[at[0] : at[-1]]
    return out


def _packed(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """(part, seq, dims, ids binary, matrix binary): consecutive ids of each partition packed ``size`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        part, seq, n = 0, 0, 0

        def pack(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "dims": [matrix.shape[1]], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]})

        for batch in batches:
            for a in range(0, len(batch), size):
                some = batch.slice(a, size)
                part = some.column("part")[0].as_py()
                held_ids.append(some.column("id").to_numpy())
                held.append(_matrix(some.column("v"), scale))
                n += len(some)
                if n >= size:
                    wide = max(m.shape[1] for m in held)
                    ids, matrix = np.concatenate(held_ids), np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in held])
                    yield pack(ids[:size], matrix[:size])
                    held_ids, held, seq, n = [ids[size:]], [matrix[size:]], seq + 1, n - size
        if n:
            wide = max(m.shape[1] for m in held)
            yield pack(np.concatenate(held_ids), np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in held]))

    ranged = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()).select("part", "id", "v")
    return ranged.mapInArrow(run, "part long, seq long, dims long, ids binary, matrix binary")


def _scores(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(docs).max(initial=0)) * max(1, queries.shape[1])
    if bound < EXACT:
        return (queries.astype(np.float64) @ docs.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return queries @ docs.T
    exact = queries.astype(object) @ docs.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Blocks:
    """Forward index of a chunk: vectors in blocks of consecutive ids, with the largest and smallest value of each term (dimension) per block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.first = np.arange(0, len(ids), BLOCK)
        self.most = np.maximum.reduceat(matrix, self.first, axis=0)
        self.least = np.minimum.reduceat(matrix, self.first, axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, blocks): no vector of the block scores more. Negative query components meet the smallest value."""
        up = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        top = np.concatenate([self.most, self.least], axis=1)
        return _scores(up, top)


class Best:
    """The k best so far of a group of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), NONE)
        self.who = np.full((len(ids), k), LAST)

    def visit(self, blocks: Blocks) -> None:
        """Scores the blocks of a chunk, each query's in the order of its own falling bounds; a query ends with the first block whose bound is below its kth score.

        The group goes through the ranks of these orders together, and queries that want the same block at the same rank are scored at once.
        """
        queries, matrix = _same_width(self.queries, blocks.matrix)
        bounds = blocks.bounds(queries)
        order = np.argsort(-(bounds + 1), axis=1, kind="stable")
        going = np.arange(len(queries))
        for rank in range(order.shape[1]):
            wanted = order[going, rank]
            on = bounds[going, wanted] >= self.score[going, -1]
            going, wanted = going[on], wanted[on]
            if not len(going):
                return
            for block in np.unique(wanted):
                self._take(blocks, matrix, queries, going[wanted == block], block)

    def _take(self, blocks: Blocks, matrix: np.ndarray, queries: np.ndarray, rows: np.ndarray, block: int) -> None:
        a = blocks.first[block]
        ids = blocks.ids[a : a + BLOCK]
        own = self.ids[rows][:, None] == ids[None, :]
        scores = np.where(own, NONE, np.maximum(_scores(queries[rows], matrix[a : a + BLOCK]), NONE + 1))
        scores = np.concatenate([self.score[rows], scores], axis=1)
        names = np.concatenate([self.who[rows], np.where(own, LAST, np.broadcast_to(ids, own.shape))], axis=1)
        order = np.lexsort((names, -(scores + 1)), axis=1)[:, : self.k]
        self.score[rows], self.who[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, wide - a.shape[1]))), np.pad(b, ((0, 0), (0, wide - b.shape[1])))


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}matrix"], np.int64).reshape(len(ids), row[f"{prefix}dims"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: float = 256.0, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query by the integer inner product of floor(scale * component), the query's own id left out; ties go to the smaller id.

    Rows without an id, without a vector, or with a null or non-finite component take no part on either side; an empty vector scores 0; shorter vectors count as padded with zeros; equal vectors are
    ranked by id; rows that share an id are candidates each, and queries each. All, if there are fewer than k. Scores beyond 64 bits stop at its ends.

    Groups of queries meet chunks of blocks of consecutive ids in the cells of a grid, CELL groups by CELL chunks each, so neither side is sent whole to any task. A task carries the scores of
    up to CELL groups on from chunk to chunk, in whatever order chunks and groups come, so blocks with a bound below a query's kth score are never scored; a group beyond that puts the one used longest ago out
    with what it has found so far, which the last ranking joins.
    """
    chunks = cut_lineage(_packed(usable(vectors, ident, vector), BLOCK * CHUNK_BLOCKS, scale))
    groups = cut_lineage(_packed(usable(queries, ident, vector), GROUP, scale))
    across, down = (max(1, -(-df.count() // CELL)) for df in (chunks, groups))
    place = lambda n: F.pmod(F.xxhash64("part", "seq"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = groups.select(F.concat_ws("-", "part", "seq").alias("grp"), *[F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "matrix")], place(down).alias("y"), every(across).alias("x"))
    right = chunks.select("dims", "ids", "matrix", place(across).alias("x"), every(down).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Best] = {}  # the one used longest ago first

        def told(name: str) -> pa.RecordBatch:
            now = held.pop(name)
            row, col = np.nonzero(now.who < LAST)
            columns = [pa.array([name] * len(row), pa.string()), *map(pa.array, (row, now.ids[row], now.who[row, col], now.score[row, col]))]
            return pa.RecordBatch.from_arrays(columns, ["grp", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                name = row["grp"]
                if name not in held and len(held) == CELL:
                    yield told(next(iter(held)))
                held[name] = held.pop(name, None) or Best(*_unpacked(row, "q_"), k)
                held[name].visit(Blocks(*_unpacked(row, "")))
        for name in list(held):
            yield told(name)

    found = left.join(right, ["x", "y"]).drop("x", "y").mapInArrow(run, "grp string, row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
