"""A Merkle manifest of a table: trees of eight, one per group, under a tree of the groups; and proofs for all leaves from one shared multiproof per partition.

Nodes are hex digests with coordinates (tree, level, place). A partition of consecutive leaves works out by arithmetic which nodes its leaves' proofs need that its own leaves don't
give (the octopus's arms), fetches each once with one join, derives the nodes above its own leaves, and unfolds the proof of each leaf from both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.operators.ordering import with_position
from texelmill.session import cut_lineage

ARITY = 8
#: Leaves of one tree that are proved together.
PARTITION = 4096
#: Levels that one task builds at once; a task holds ARITY ** LEVELS digests.
LEVELS = 4

_NODE = "tree long, level int, place long, digest string"
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: of each field a dash if null, else the UTF-8 bytes' count, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def heights(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, up to the one on top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def arms(sizes: list[int], first: int, upto: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with the leaves first..upto-1, give all proofs of these and the root.

    Level by level: the own nodes fill whole runs with their siblings; what a run has besides them is fetched, and the runs are the own nodes of the next level.
    """
    for level, n in enumerate(sizes[:-1]):
        low, high = first // ARITY * ARITY, min(n, -(-upto // ARITY) * ARITY)
        for place in (*range(low, first), *range(upto, high)):
            yield level, place
        first, upto = low // ARITY, -(-high // ARITY)


def climb(nodes: dict[tuple[int, int], str], sizes: list[int], first: int, upto: int) -> None:
    """Adds the nodes above the leaves first..upto-1, once their arms are among ``nodes``."""
    for level, n in enumerate(sizes[:-1]):
        low, high = first // ARITY, -(-upto // ARITY)
        for run in range(low, high):
            nodes[level + 1, run] = digest("".join(nodes[level, i] for i in range(run * ARITY, min(n, (run + 1) * ARITY))))
        first, upto = low, high


def path(nodes: dict[tuple[int, int], str], sizes: list[int], place: int) -> list[dict[str, str]]:
    """Per level what stands left and right of a leaf's way to the root within its run."""
    out = []
    for level, n in enumerate(sizes[:-1]):
        low, high = place // ARITY * ARITY, min(n, (place // ARITY + 1) * ARITY)
        out.append({"left": "".join(nodes[level, i] for i in range(low, place)), "right": "".join(nodes[level, i] for i in range(place + 1, high))})
        place //= ARITY
    return out


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def build(leaves: DataFrame) -> tuple[DataFrame, int]:
    """All nodes of the trees of ``leaves`` (tree, place, digest, n: leaves of its tree), the leaves among them, and the number of levels of the tallest.

    A round builds LEVELS levels above blocks of ARITY ** LEVELS nodes, one block a group; the last level's nodes are the leaves of the next round.
    """
    wide = ARITY**LEVELS

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, at, n, level = (k.as_py() for k in key)
        rows = rows.sort_by("place")
        sizes = heights(n)[: LEVELS + 1]
        first = at * wide
        nodes = {(0, first + i): d for i, d in enumerate(rows["digest"].to_pylist())}
        upto, out = first + len(nodes), []
        climb(nodes, sizes, first, upto)
        out = [(tree, level + k, i, d, k == len(sizes) - 1) for (k, i), d in nodes.items() if k]
        kinds = [("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())]
        return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    current = leaves.select("tree", "place", "digest", F.col("n").cast("long").alias("n"))
    whole = current.select("tree", F.lit(0).alias("level"), "place", "digest")
    most = current.agg(F.max("n")).first()[0] or 0
    level = 0
    while most > 1:
        key = [F.col("tree"), F.floor(F.col("place") / wide).alias("at"), F.col("n"), F.lit(level).alias("level")]
        made = cut_lineage(current.where("n > 1").groupBy(*key).applyInArrow(block, f"{_NODE}, last boolean"))
        whole = whole.unionByName(made.drop("last"))
        sizes = current.where("n > 1").select("tree", "n").distinct()
        for _ in range(LEVELS):
            most = -(-most // ARITY)
            sizes = sizes.withColumn("n", F.ceil(F.col("n") / ARITY))
        level += LEVELS
        current = cut_lineage(made.where("last").join(sizes.where("n > 1"), "tree").select("tree", "place", "digest", "n"))
    return whole, len(heights(leaves.agg(F.max("n")).first()[0] or 1))


def prove(leaves: DataFrame, nodes: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(tree, place, path) of every leaf: from its partition's multiproof.

    ``leaves`` is (tree, place, digest, n), ``nodes`` those of :func:`build`. Partitions are ``partition`` consecutive leaves of a tree. A task holds a partition's leaves and its arms, some seven a level and side.
    """

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, part, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = list(arms(heights(n), part * partition, min(n, (part + 1) * partition)))
                if got:
                    level, place = zip(*got)
                    columns = [pa.array([tree] * len(got)), pa.array([part] * len(got)), pa.array(level, pa.int32()), pa.array(place, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "part", "level", "place"])

    own = leaves.withColumn("part", F.floor(F.col("place") / partition))
    parts = own.groupBy("tree", "part").agg(F.max("n").alias("n")).select(F.col("tree").cast("long").alias("tree"), F.col("part").cast("long").alias("part"), "n")
    asked = parts.mapInArrow(wanted, "tree long, part long, level int, place long")
    fetched = asked.join(nodes, ["tree", "level", "place"]).select("tree", "part", F.lit(None).cast("long").alias("n"), "level", "place", "digest")
    held = own.select("tree", "part", "n", F.lit(0).alias("level"), "place", "digest")

    def unfold(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        nodes_, mine, n = {}, [], 0
        for size, level, place, d in zip(*(rows[c].to_pylist() for c in ("n", "level", "place", "digest"))):
            nodes_[level, place] = d
            if size is not None:
                mine.append(place)
                n = size
        sizes = heights(n)
        climb(nodes_, sizes, min(mine), max(mine) + 1)
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([pa.array([tree] * len(mine), pa.int64()), pa.array(mine, pa.int64()), pa.array([path(nodes_, sizes, p) for p in mine], kind)], names=["tree", "place", "path"])

    return held.unionByName(fetched).groupBy("tree", "part").applyInArrow(unfold, f"tree long, place long, path {_PATH}")


def dataset_manifest(rows: DataFrame, leaf: Column, group: str, order: str, keep: dict[str, Column] | None = None, partition: int = PARTITION) -> DataFrame:
    """One row per row of ``rows``: ``order``, ``group``, ``leaf``, ``subroot`` of its group, ``root`` of all, ``path`` from the leaf by way of the subroot to the root, and the columns ``keep``.

    Groups go by UTF-8 bytes, null first as a group of its own; the leaves of a group by ``order``, null first, ties by digest. Every eight consecutive nodes of a level, the last of them
    fewer, become the digest of their digests, until one is left; groups' roots likewise. A lone leaf is its group's root, a lone group's root the root. Equal rows are leaves of their own. No
    rows give no rows. Columns of other names don't matter; those kept may have any name but the ones returned.

    Texts are read once, for the leaves; from then on a row is its digests. Leaves are placed by range partitions, so a hot group spreads; groups are a table of one row each, joined by
    size. Two shuffles of leaves follow, one for the trees and one for the proofs, in groups of at most ARITY ** LEVELS and ``partition`` rows.
    """
    keep = keep or {}
    kept = [f"k{i}" for i in range(len(keep))]
    given = rows.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf.alias("digest"), *[c.alias(k) for k, c in zip(kept, keep.values())])
    given = given.withColumn("row", F.monotonically_increasing_id())
    placed = cut_lineage(with_position(given, [F.col("grp"), F.col("ord"), F.col("digest"), F.col("row")], "at").drop("row"))
    groups = placed.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = cut_lineage(with_position(groups, [F.col("grp")], "tree"))
    same = F.col("grp").eqNullSafe(F.col("g"))
    leaves = placed.join(groups.withColumnRenamed("grp", "g"), same).drop("g").withColumn("place", F.col("at") - F.col("first")).drop("at", "first")
    leaves = cut_lineage(leaves)

    nodes, _ = build(leaves)
    top = F.col("level") == _height(F.col("n"))
    subroots = nodes.join(groups.select("tree", "n"), "tree").where(top).select("tree", F.col("digest").alias("subroot"))
    count = groups.count()
    upper = cut_lineage(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"), F.lit(count).cast("long").alias("n")))
    roots, levels = build(upper)
    above = prove(upper, roots, partition).select(F.col("place").alias("tree"), F.col("path").alias("above"))
    root = roots.where(F.col("level") == levels - 1).select(F.col("digest").alias("root"))
    above = above.join(upper.select(F.col("place").alias("tree"), F.col("digest").alias("subroot")), "tree")
    above = cut_lineage(above.withColumn("root", F.lit(row.root if (row := root.first()) else None).cast("string")))

    proofs = prove(leaves, nodes, partition)
    out = leaves.join(proofs, ["tree", "place"]).join(above, "tree")
    names = [F.col(k).alias(c) for k, c in zip(kept, keep)]
    return out.select(F.col("ord").alias(order), F.col("grp").alias(group), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"), *names)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(21)])
    return F.size(F.filter(powers, lambda p: p < n))
