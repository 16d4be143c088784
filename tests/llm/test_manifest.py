"""Merkle trees, multiproofs and proofs against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from texelmill.llm import manifest
from texelmill.llm.manifest import digest


def tree(leaves):
    """All levels of a tree of eight."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 100, 513])
def test_arms_are_enough_and_fewest(n):
    rng, leaves = random.Random(n), [digest(str(i)) for i in range(n)]
    levels, sizes = tree(leaves), manifest.heights(n)
    assert sizes == [len(x) for x in levels]
    for _ in range(10):
        first = rng.randrange(n)
        upto = rng.randrange(first, n) + 1
        got = list(manifest.arms(sizes, first, upto))
        own = [{*range(first, upto)}]
        for _ in levels[1:]:
            own.append({i // 8 for i in own[-1]})
        needed = {(k, j) for k, level in enumerate(levels[:-1]) for i in own[k] for j in range(i // 8 * 8, min(len(level), i // 8 * 8 + 8)) if j not in own[k]}
        assert set(got) == needed and len(got) == len(needed)
        nodes = {(k, i): levels[k][i] for k, i in got} | {(0, i): leaves[i] for i in range(first, upto)}
        manifest.climb(nodes, sizes, first, upto)
        assert nodes[len(levels) - 1, 0] == levels[-1][0]
        for i in range(first, upto):
            assert [(s["left"], s["right"]) for s in manifest.path(nodes, sizes, i)] == siblings(levels, i)


@pytest.mark.parametrize("levels, partition", [(4, 4096), (1, 5), (2, 1), (1, 100)])
def test_manifest(spark, monkeypatch, levels, partition):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rng = random.Random(levels)
    names = ["en", "en", "en", "en", None, "", "é", "z", "\U0001f600", "￿", *(f"l{i}" for i in range(12))]
    rows = [(rng.choice([None, *range(500)]), rng.choice([None, "", "a", "ü"]), rng.choice(names), i % 3 and i, "x") for i in range(700)]
    rows += [(None, "same", "en", 1, "x")] * 30 + [(1, "alone", "one of its own", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, place long, tree string").repartition(5)
    fields = [F.col(c) for c in ("doc_id", "text", "lang", "place")]
    out = manifest.dataset_manifest(docs, manifest.leaf_digest(*fields), "lang", "doc_id", {"place": F.col("place"), "part": F.col("text")}, partition)
    assert out.columns == ["doc_id", "lang", "leaf", "subroot", "root", "path", "place", "part"]
    got = out.withColumn("folded", manifest.fold(F.col("leaf"), F.col("path"))).collect()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for d, t, g, p, _ in rows:
        groups[g].append((d is not None, d or 0, digest("".join(map(said, (d, t, g, p))))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, _, leaf in sorted(groups[g])]) for g in order}
    upper = tree([trees[g][-1][0] for g in order])
    want = []
    for k, g in enumerate(order):
        for i, (there, d, leaf) in enumerate(sorted(groups[g])):
            want.append((d if there else None, g, leaf, trees[g][-1][0], upper[-1][0], [*siblings(trees[g], i), *siblings(upper, k)]))
    assert sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.folded == r.root for r in got)


def test_small_tables(spark):
    docs = frame(spark, ["a"])
    leaf = manifest.leaf_digest(F.col("doc_id"), F.col("text"))
    row = manifest.dataset_manifest(docs, leaf, "lang", "doc_id").first()
    assert row.leaf == row.subroot == row.root == digest("1:01:a") and row.path == []
    assert manifest.dataset_manifest(docs.limit(0), leaf, "lang", "doc_id").collect() == []


def test_tampering_shows(spark):
    docs = frame(spark, [f"Text {i}" for i in range(70)], langs=("en", "de", None))
    leaf = manifest.leaf_digest(F.col("doc_id"), F.col("text"))
    changed = manifest.leaf_digest(F.col("doc_id"), F.lower("text"))
    out = manifest.dataset_manifest(docs, leaf, "lang", "doc_id", {"changed": changed})
    rows = out.select("root", manifest.fold(F.col("leaf"), F.col("path")).alias("a"), manifest.fold(F.col("changed"), F.col("path")).alias("b")).collect()
    assert all(r.a == r.root != r.b for r in rows)
