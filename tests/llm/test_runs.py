"""Periodic runs against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.helpers import frame, words
from texelmill.llm import runs


def expected_runs(w):
    """All maximal stretches of every period, the smallest period of each stretch."""
    n, out = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((a, length, p) for (a, length), p in out.items())


def periodic(rng, size):
    w = []
    while len(w) < size:
        k = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 100])
        root = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(k)]
        w += (root * rng.choice([1, 2, 3, 4, 9, 30]))[: rng.randrange(1, 400)]
        w += [rng.randrange(3) for _ in range(rng.choice([0, 1, 5]))]
    return w


def stitched(found):
    out = []
    for p in {p for p, _, _ in found}:
        spans = sorted((a, b) for q, a, b in found if q == p)
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(a, b - a + p, p) for a, b in merged if b - a + p >= max(24, 3 * p)]
    return sorted(out)


@pytest.mark.parametrize("together", [1, 2, 1024])
def test_fragments_of_random_texts(monkeypatch, together):
    monkeypatch.setattr(runs, "TILES", together)
    rng = random.Random(together)
    for _ in range(300):
        w = periodic(rng, rng.choice([20, 30, 100, 400, 900]))
        assert stitched(runs.fragments(np.array(w))) == expected_runs(w)


def test_equal_hashes_change_nothing(monkeypatch):
    """Hashes only choose tiles: with all of them equal the runs stay the same."""
    real = runs._wider
    monkeypatch.setattr(runs, "_wider", lambda gram, size: np.zeros_like(real(gram, size)))
    rng = random.Random(8)
    for _ in range(40):
        w = periodic(rng, 150)
        assert stitched(runs.fragments(np.array(w))) == expected_runs(w)


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(0, 30))]
        z = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s, len(s)) == z


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(runs, "TILES", 2)
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a b", "x " * 24, "x " * 23, "x " * 5000, *(" ".join(f"w{i}" for i in periodic(rng, 300)) for _ in range(20))]
    texts += [texts[-1], "\x1c ".join(["a", "b"] * 20), " ".join(["a"] * 50), "a\x0bb\x0c" * 30]
    docs = frame(spark, texts).withColumnRenamed("rank", "runs").withColumnRenamed("root", "period")
    got = runs.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "period", "n_words", "runs"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words(texts[r.doc_id])
        want = expected_runs(w)
        gone = {i for a, length, p in want for i in range(a + p, a + length)}
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
        assert r.text == " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.id, r.period) == ("x", 2)
    assert runs.collapse_runs(docs.limit(0)).collect() == []
    nobody = docs.selectExpr("cast(null as long) as doc_id", "text")
    assert sorted((r.text for r in runs.collapse_runs(nobody).collect())) == sorted(r.text for r in rows)
