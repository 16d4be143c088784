"""Quantizers against plain sequential versions on random histograms."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from texelmill.operators import quantize
from texelmill.plans.views import Tables

RGB = ["r", "g", "b"]


def histograms(seed: int, images: int = 4, size: int = 300):
    rng, out = random.Random(seed), {}
    for i in range(images):
        spread = rng.choice([3, 20, 256])
        base = [rng.randrange(257 - spread) for _ in range(3)]
        out[i] = {tuple(b + rng.randrange(spread) for b in base): rng.choice([1, 1, 2, 50, 3000]) for _ in range(rng.choice([1, 5, size]))}
    return out


def frame(spark, hists):
    return spark.createDataFrame([(i, *c, n) for i, h in hists.items() for c, n in h.items()], "image_id long, r int, g int, b int, n long")


def mean(colors, hist):
    n = sum(hist[c] for c in colors)
    return tuple(int(sum(c[i] * hist[c] for c in colors) / n + 0.5 + 1e-9) for i in range(3))


def octree(hist, k):
    """Nodes as colour prefixes; the least populated node of the deepest level becomes a leaf until there are at most k leaves."""
    leaves = {(8, c): [c] for c in hist}
    for level in range(7, -1, -1):
        kin = defaultdict(list)
        for (depth, c), colors in leaves.items():
            if depth == level + 1:
                kin[tuple(v >> (8 - level) << (8 - level) for v in c)].append((depth, c))
        for parent in sorted(kin, key=lambda p: (sum(hist[x] for leaf in kin[p] for x in leaves[leaf]), p)):
            if len(leaves) <= k:
                return [v for v in leaves.values()]
            leaves[level, parent] = [x for leaf in kin[parent] for x in leaves.pop(leaf)]
    return [v for v in leaves.values()]


def best_first(hist, k, target):
    def stats(colors):
        n = sum(hist[c] for c in colors)
        sums = [sum(hist[c] * c[i] for c in colors) for i in range(3)]
        return n, sums, sum(hist[c] * sum(v * v for v in c) for c in colors) - sum(s * s for s in sums) / n

    def split(colors):
        n, sums, _ = stats(colors)
        best = (0.0, 0, 0)
        for chan in range(3):
            for cut in sorted({c[chan] for c in colors})[:-1]:
                left, part, _ = stats([c for c in colors if c[chan] <= cut])
                gain = sum(((n - left) * part[i] - left * (sums[i] - part[i])) ** 2 for i in range(3)) / (n * left * (n - left))
                best = max(best, (gain, -chan, -cut))
        return best

    boxes = {0: list(hist)}
    gains = {0: split(boxes[0])}
    error, pixels = stats(boxes[0])[2], sum(hist.values())
    while len(boxes) < k and error > target * pixels:
        at = max(boxes, key=lambda b: (gains[b][0], -b))
        gain, chan, cut = gains[at][0], -gains[at][1], -gains[at][2]
        if gain <= 0:
            break
        new = len(boxes)
        boxes[new] = [c for c in boxes[at] if c[chan] > cut]
        boxes[at] = [c for c in boxes[at] if c[chan] <= cut]
        gains[at], gains[new] = split(boxes[at]), split(boxes[new])
        error -= gain
    return boxes


def farthest(hist, k):
    order = sorted(hist, key=lambda c: (-hist[c], c))
    chosen = [order[0]]
    apart = lambda c: min(sum((x - y) ** 2 for x, y in zip(c, p)) for p in chosen)
    while len(chosen) < min(k, len(order)):
        chosen.append(max(order, key=lambda c: (apart(c), hist[c], [-v for v in c])))
    return chosen


@pytest.mark.parametrize("k", [1, 5, 16, 100])
def test_octree(spark, k):
    hists = histograms(k)
    got = defaultdict(list)
    for r in quantize.fast_octree(frame(spark, hists), k)["palette"].collect():
        got[r.image_id].append((r.r, r.g, r.b))
    for i, h in hists.items():
        assert sorted(got[i]) == sorted(mean(leaf, h) for leaf in octree(h, k)) and len(got[i]) <= k


def test_octree_is_no_worse_than_buckets(spark):
    from tests.test_properties import weighted_error

    hist = Tables(spark, "/root/testdata/sf0.001")("hist")
    tree, flat = (weighted_error(hist, method(hist, 32)) for method in (quantize.fast_octree, quantize.fullest_buckets))
    assert sum(tree.values()) <= sum(flat.values())


@pytest.mark.parametrize("k, target", [(2, 0.0), (12, 0.0), (40, 30.0), (40, 500.0)])
def test_best_first(spark, k, target):
    hists = histograms(k, size=120)
    got = defaultdict(lambda: defaultdict(set))
    for r in quantize.variance_split(frame(spark, hists), k, target).collect():
        got[r.image_id][r.box].add((r.r, r.g, r.b))
    for i, h in hists.items():
        assert dict(got[i]) == {b: set(c) for b, c in best_first(h, k, target).items()}


def test_quality_floor(spark):
    rng = random.Random(3)
    hists = {i: {tuple(rng.randrange(spread) for _ in range(3)): rng.randrange(1, 9) for _ in range(200)} for i, spread in enumerate([4, 12, 256, 200])}
    hist = frame(spark, hists)
    out = quantize.quality_bounded(hist, 6)
    told = {r.image_id: r for r in out["quality"].collect()}
    plain = {(r.image_id, r.idx): (r.r, r.g, r.b) for r in quantize.median_cut(hist, 6)["palette"].collect()}
    own = {(r.image_id, r.idx): (r.r, r.g, r.b) for r in out["palette"].collect()}
    fell = {i for i, r in told.items() if r.fell_back}
    assert fell and set(told) - fell and set(told) == set(hists)
    assert all((told[i].mse > quantize.quality_error(85)) == (i in fell) for i in told)
    assert {x: c for x, c in own.items() if x[0] in fell} == {x: c for x, c in plain.items() if x[0] in fell}
    assert out["color_map"].count() == hist.count()


def test_quality_curve():
    values = [quantize.quality_error(q) for q in range(101)]
    assert values[-1] == 0 and all(a > b for a, b in zip(values, values[1:]))


@pytest.mark.parametrize("k", [1, 2, 20, 60])
def test_farthest_colors(spark, k):
    hists = histograms(k + 50, images=5, size=400)
    out = quantize.max_coverage(frame(spark, hists), k)
    got = defaultdict(list)
    for r in out["palette"].collect():
        got[r.image_id].append((r.r, r.g, r.b))
    for i, h in hists.items():
        assert sorted(got[i]) == sorted(farthest(h, k))


def test_farthest_colors_of_a_wide_image(spark):
    """A hundred thousand colours of one image, none of them in one task's group: what a walk sees is cells."""
    hist = spark.range(100_000).select(F.lit(0).alias("image_id"), *[(F.abs(F.hash(F.col("id"), F.lit(i))) % 256).cast("int").alias(c) for i, c in enumerate(RGB)]).distinct().withColumn("n", F.lit(1).cast("long"))
    rows = [(r.r, r.g, r.b) for r in hist.collect()]
    import numpy as np

    colors = np.array(sorted(rows))
    chosen, reach = [0], ((colors - colors[0]) ** 2).sum(axis=1)
    for _ in range(11):
        chosen.append(int(np.argmax(reach)))
        reach = np.minimum(reach, ((colors - colors[chosen[-1]]) ** 2).sum(axis=1))
    got = sorted((r.r, r.g, r.b) for r in quantize.max_coverage(hist, 12)["palette"].collect())
    assert got == sorted(map(tuple, colors[chosen].tolist()))


@pytest.mark.parametrize("method", ["variance_split", "max_coverage", "median_cut"])
def test_images_solved_whole_match_the_rounds(spark, monkeypatch, method):
    """Images of few colours take one pass, however deep their splits or many their picks, and large ones beside them give what they gave."""
    hists = frame(spark, histograms(7, images=6, size=500))
    written, cut = [], quantize.cut_lineage
    monkeypatch.setattr(quantize, "cut_lineage", lambda df: written.append(df) or cut(df))

    def run(most):
        monkeypatch.setattr(quantize, "WHOLE_COLORS", most)
        out = getattr(quantize, method)(hists, 40)
        out = out if method == "variance_split" else out["color_map"].withColumnRenamed("idx", "box")
        return sorted(map(tuple, out.select("image_id", *RGB, "box").collect()))

    whole = run(1 << 16)
    assert len(written) <= 4
    assert run(0) == whole and run(100) == whole


def test_tables_of_colors_are_not_broadcast(spark):
    """A table of an image's colours grows with the pixels, however small its file is."""
    px = spark.range(20_000).selectExpr("id % 20 as image_id", "cast(id / 20 as int) % 32 as x", "cast(id / 640 as int) as y", *[f"abs(hash(id, {i})) % 16 as {c}" for i, c in enumerate(RGB)], "255 as a")
    out = quantize.quantize(px, "median_cut", 8, None)
    planned = [out["index_image"], quantize._assigned(out["hist"], out["palette"])]
    for df in planned:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        builds = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
        assert not any(" r#" in line or "[r#" in line or ", r#" in line for line in builds), plan


def test_cells_of_small_scopes_match_the_spread_ones(spark, monkeypatch):
    """Scopes of few colours unfold no row per edge, and large ones beside them get the same clusters."""
    from texelmill.operators import cluster

    colors = cluster.with_color_features(frame(spark, histograms(11, images=6, size=400)).withColumnRenamed("image_id", "scope"), "scope")

    def run(most, target):
        monkeypatch.setattr(cluster, "WHOLE_COLORS", most)
        out = cluster.cluster_cells(colors, "scope", target)
        if most == 1 << 16:
            assert "Generate" not in out._jdf.queryExecution().sparkPlan().toString()
        return sorted(map(tuple, out.select("scope", *RGB, "threshold", "cluster", "weight").collect()))

    for target in (1, 40, 1000):
        whole = run(1 << 16, target)
        assert run(0, target) == whole and run(100, target) == whole
