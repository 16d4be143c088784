"""Per-image colour quantization. Every method starts from the colour histogram, never from pixels.

Methods give ``palette`` (image_id, idx, r, g, b; at most K entries) and ``color_map`` (image_id, r, g, b -> idx).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import color
from texelmill.operators.histogram import color_histogram
from texelmill.operators.mapping import by_color, nearest_entries
from texelmill.operators.neighborhood import smooth_dither
from texelmill.session import cut_lineage

RGB = ["r", "g", "b"]
# fixed values: names of the quantization methods; unknown names mean median_cut
METHODS = ("median_cut", "max_coverage", "fast_octree", "libimagequant", "kmeans_adaptive", "uniform")
ERROR_WEIGHTED_ROUNDS = 3
KMEANS_ROUNDS = 2
#: Values of a channel in a cell of colours.
CELL = 8
#: An image of at most so many colours is solved in one call; the colours of a larger one stay spread over tasks, in rounds.
WHOLE_COLORS = 1 << 16


def _mean(c: str) -> Column:
    return F.floor(F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6) + 0.5).cast("int").alias(c)


def _with_dense_idx(means: DataFrame) -> DataFrame:
    """Palette indices in (r, g, b, box) order; at most K rows per image."""
    w = Window.partitionBy("image_id").orderBy(*RGB, "box")
    return means.withColumn("idx", F.row_number().over(w) - 1)


def _by_size(hist: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``hist`` of the images of at most WHOLE_COLORS colours, and of the others (None if there are none)."""
    hist = cut_lineage(hist.select("image_id", *RGB, F.col("n").cast("long").alias("n")))
    large = cut_lineage(hist.groupBy("image_id").count().where(F.col("count") > WHOLE_COLORS).select("image_id"))
    if not large.limit(1).collect():
        return hist, None
    return hist.join(large, "image_id", "left_anti"), hist.join(large, "image_id", "left_semi")


def _numbers(colors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([colors.column(c).to_numpy() for c in RGB]).astype(np.int64), colors.column("n").to_numpy()


def _assigned(hist: DataFrame, palette: DataFrame) -> DataFrame:
    """``hist`` with each colour's nearest entry ``idx``; ``n`` goes along with the search, so the histogram meets nothing of its own size."""
    return nearest_entries(hist, palette, "image_id", keep=("n",))


def _result(palette: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    return {"palette": palette.select("image_id", "idx", *RGB), "color_map": assigned.select("image_id", *RGB, "idx")}


def _nearest(hist: DataFrame, palette: DataFrame) -> dict[str, DataFrame]:
    return _result(palette, nearest_entries(hist, palette, "image_id"))


def _split_round(boxes: DataFrame, k: int) -> DataFrame:
    """Split the boxes of largest weighted spread at the weighted median of their widest channel, as many as fit below ``k``."""
    w = Window.partitionBy("image_id", "box")
    span = {c: F.max(c).over(w) - F.min(c).over(w) for c in RGB}
    boxes = boxes.withColumns({f"_s{c}": s for c, s in span.items()})
    sr, sg, sb = (F.col(f"_s{c}") for c in RGB)
    widest = F.when((sg >= sr) & (sg >= sb), F.col("g")).when(sr >= sb, F.col("r")).otherwise(F.col("b"))
    boxes = boxes.withColumn("_v", widest)
    upto = F.sum("n").over(w.orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
    boxes = boxes.withColumns({"_upto": upto, "_all": F.sum("n").over(w), "_top": F.max("_v").over(w), "_low": F.min("_v").over(w)})
    # smallest value whose running weight reaches half; the largest value always goes right
    half = F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("_v"))).over(w)
    spread = F.col("_all") * (F.col("_top") - F.col("_low"))
    per_image = Window.partitionBy("image_id")
    boxes = boxes.withColumns({"_half": half, "_rank": F.dense_rank().over(per_image.orderBy(spread.desc(), "box"))})
    room = F.lit(k) - F.max("_rank").over(per_image)
    cut = F.when(F.col("_half") == F.col("_top"), F.col("_half") - 1).otherwise(F.col("_half"))
    right = (F.col("_v") > cut) & (F.col("_top") > F.col("_low")) & (F.col("_rank") <= room)
    return boxes.withColumn("box", F.col("box") * 2 + right.cast("long")).select("image_id", *RGB, "n", "box")


def _cut_image(rgb: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Box numbers of one image's colours, in the rounds of :func:`_split_round`."""
    box = np.zeros(len(n), np.int64)
    while True:
        boxes, box = np.unique(box, return_inverse=True)
        if len(boxes) >= min(len(n), k):
            return box
        by = np.argsort(box, kind="stable")
        starts = np.searchsorted(box[by], np.arange(len(boxes)))
        low, top = np.minimum.reduceat(rgb[by], starts), np.maximum.reduceat(rgb[by], starts)
        sr, sg, sb = (top - low).T
        chan = np.where((sg >= sr) & (sg >= sb), 1, np.where(sr >= sb, 0, 2))
        v, one = rgb[np.arange(len(n)), chan[box]], np.arange(len(boxes))
        low, top = low[one, chan], top[one, chan]
        by = np.lexsort((v, box))
        upto, total = np.cumsum(n[by]), np.add.reduceat(n[by], starts)
        upto = upto - (upto[starts] - n[by][starts])[box[by]]
        reached = upto * 2 >= total[box[by]]
        # the first row of each box that reaches half of its weight
        half = v[by][np.minimum.reduceat(np.where(reached, np.arange(len(n)), len(n)), starts)]
        rank = np.empty(len(boxes), np.int64)
        rank[np.lexsort((one, -total * (top - low)))] = one
        cut = np.where(half == top, half - 1, half)
        box = box * 2 + ((v > cut[box]) & ((top > low) & (rank < k - len(boxes)))[box])


def median_cut(hist: DataFrame, k: int) -> dict[str, DataFrame]:
    """min(k, colours) boxes per image: rounds that split every box while they fit, then the best ones, until nothing is left to split.

    Images of at most WHOLE_COLORS colours are solved in one pass, a call each; larger ones go through :func:`_cut_rounds`, which gives the same boxes.
    """
    kind = dict(hist.dtypes)["image_id"]

    def solve(colors: pa.Table) -> pa.Table:
        return colors.append_column("box", pa.array(_cut_image(*_numbers(colors), k)))

    small, large = _by_size(hist)
    boxes = small.groupBy("image_id").applyInArrow(solve, f"image_id {kind}, r int, g int, b int, n long, box long")
    boxes = cut_lineage(boxes if large is None else boxes.unionByName(_cut_rounds(large, k)))
    means = boxes.groupBy("image_id", "box").agg(*[_mean(c) for c in RGB])
    palette = _with_dense_idx(means)
    assigned = boxes.join(palette.select("image_id", "box", "idx"), ["image_id", "box"])
    return _result(palette, assigned)


def _cut_rounds(hist: DataFrame, k: int) -> DataFrame:
    """``hist`` with the ``box`` of :func:`median_cut`, for images of any size.

    The histogram is placed by image once; the windows of a batch of rounds reuse that placement, so they share ONE shuffle.
    A window holds the distinct colours of a box, at most 2^24 however many pixels the image has. Hot colours can make boxes of one colour early; the
    rounds then go on with the others.
    """
    boxes, rounds = hist.withColumn("box", F.lit(0).cast("long")), max(k - 1, 0).bit_length()
    while True:
        boxes = boxes.repartition("image_id")
        for _ in range(rounds):
            boxes = _split_round(boxes, k)
        # short box numbers again, in the same order
        boxes = cut_lineage(boxes.withColumn("box", F.dense_rank().over(Window.partitionBy("image_id").orderBy("box")).cast("long")))
        size = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("colors"), F.max("box").alias("boxes"))
        if not size.where(F.col("boxes") < F.least("colors", F.lit(k))).limit(1).collect():
            break
        rounds = 4
    return boxes


def fast_octree(hist: DataFrame, k: int) -> dict[str, DataFrame]:
    """An octree of colours, one level a bit, reduced from the leaves up: the deepest level first, in it the least populated siblings, until k leaves are left. The leaves' weighted means are the palette.

    A level's nodes are colours cut to its bits. Every level that is still too wide is merged whole, whatever the order, so one count of nodes per level tells where the reduction ends: below the deepest
    level of at most k nodes. Only the siblings under that level's nodes, at most k a image, are put in an order.
    """
    cut = lambda drop: color.pack_rgb(*[F.shiftleft(F.shiftright(F.col(c), drop), drop) for c in RGB])
    level = hist.select("image_id", F.explode(F.array(*[F.struct(F.lit(8 - d).alias("level"), cut(d).alias("node")) for d in range(9)])).alias("at"))
    sizes = level.select("image_id", "at.*").distinct().groupBy("image_id", "level").agg(F.count("*").alias("nodes"))
    fit = sizes.groupBy("image_id").agg(F.max(F.when(F.col("nodes") <= k, F.col("level"))).alias("level"), F.map_from_entries(F.collect_list(F.struct("level", "nodes"))).alias("_all"))
    fit = cut_lineage(fit.select("image_id", (8 - F.col("level")).alias("drop"), (F.coalesce(F.element_at("_all", F.col("level") + 1), F.lit(k)) - k).alias("over")))
    at = lambda drop: color.pack_rgb(*[F.expr(f"shiftleft(shiftright({c}, {drop}), {drop})") for c in RGB])
    leaves = hist.join(fit, "image_id").withColumns({"parent": at("drop"), "child": at("greatest(drop - 1, 0)")})
    siblings = leaves.groupBy("image_id", "over", "parent", "child").agg(F.sum("n").alias("n")).groupBy("image_id", "over", "parent").agg(F.sum("n").alias("n"), (F.count("*") - 1).alias("gone"))
    before = F.sum("gone").over(Window.partitionBy("image_id").orderBy("n", "parent").rowsBetween(Window.unboundedPreceding, -1))
    merged = siblings.select("image_id", "parent", (F.coalesce(before, F.lit(0)) < F.col("over")).alias("merged"))
    boxes = leaves.join(merged, ["image_id", "parent"]).withColumn("box", F.when(F.col("merged"), F.col("parent")).otherwise(F.col("child")))
    palette = cut_lineage(_with_dense_idx(boxes.groupBy("image_id", "box").agg(*[_mean(c) for c in RGB])))
    return _nearest(hist, palette)


def fullest_buckets(hist: DataFrame, k: int, bits: int = 4) -> dict[str, DataFrame]:
    """The k fullest colour buckets of ``bits`` bits per channel, their weighted means, the rest to the nearest mean."""
    bucket = color.pack_rgb(*[F.shiftright(F.col(c), 8 - bits) for c in RGB])
    means = hist.withColumn("box", bucket).groupBy("image_id", "box").agg(F.sum("n").alias("n"), *[_mean(c) for c in RGB])
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "box"))
    palette = cut_lineage(_with_dense_idx(means.withColumn("_rank", rank).where(F.col("_rank") <= k)))
    return _nearest(hist, palette)


def lloyd(hist: DataFrame, palette: DataFrame, rounds: int) -> DataFrame:
    """Weighted Lloyd rounds: nearest centre, then mean per centre."""
    for _ in range(rounds):
        means = _assigned(hist, palette).groupBy("image_id", F.col("idx").alias("box")).agg(*[_mean(c) for c in RGB])
        palette = cut_lineage(_with_dense_idx(means).select("image_id", "idx", *RGB))
    return palette


def kmeans_adaptive(hist: DataFrame, k: int, rounds: int = KMEANS_ROUNDS) -> dict[str, DataFrame]:
    palette = lloyd(hist, fast_octree(hist, k)["palette"], rounds)
    return _nearest(hist, palette)


def error_bounded(hist: DataFrame, k: int, rounds: int = ERROR_WEIGHTED_ROUNDS) -> dict[str, DataFrame]:
    """Median cut refined by Lloyd rounds: squared error never above the plain median cut's."""
    palette = lloyd(hist, median_cut(hist, k)["palette"], rounds)
    return _nearest(hist, palette)


def quality_error(quality: float) -> float:
    """The mean squared error of a pixel, over its three channels of 0..255, that a quality of 0..100 stands for."""
    if quality >= 100:
        return 0.0
    # fixed values: the published quality curve of the default quantizer, in channels of 0..1
    return 255.0**2 * 3 * (max(0.0, 0.016 / (0.001 + quality) - 0.001) + 2.5 / (210.0 + quality) ** 1.2 * (100.1 - quality) / 100.0)


def _best_splits(boxes: DataFrame) -> DataFrame:
    """(image_id, node, n, error, gain, chan, cut): each box's squared error and the cut of one channel that removes most of it.

    Cuts are found on channel histograms, at most 768 rows a box whatever its colours: they add up map-side.
    """
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(f"s{c}") for c in RGB]]
    square = sum((F.col(f"s{c}").cast("double") * F.col(f"s{c}") for c in RGB[1:]), F.col("sr").cast("double") * F.col("sr"))
    spread = F.sum(F.col("n") * (F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b"))).cast("double").alias("q")
    error = boxes.groupBy("image_id", "node").agg(*sums, spread).select("image_id", "node", "n", (F.col("q") - square / F.col("n")).alias("error"))
    sides = boxes.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).alias("chan"), F.col(c).alias("v")) for i, c in enumerate(RGB)]))).select("*", "_c.*")
    values = sides.groupBy("image_id", "node", "chan", "v").agg(*sums)
    w = Window.partitionBy("image_id", "node", "chan")
    parts = ["n", "sr", "sg", "sb"]
    values = values.withColumns({f"l{c}": F.sum(c).over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).cast("double") for c in parts} | {f"t{c}": F.sum(c).over(w).cast("double") for c in parts})
    right = F.col("tn") - F.col("ln")
    apart = [right * F.col(f"ls{c}") - F.col("ln") * (F.col(f"ts{c}") - F.col(f"ls{c}")) for c in RGB]
    gain = F.when(right > 0, (apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]) / (F.col("tn") * F.col("ln") * right)).otherwise(0.0)
    best = values.groupBy("image_id", "node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("chan")).alias("c"), (-F.col("v")).alias("v"))).alias("best"))
    return error.join(best.select("image_id", "node", "best.gain", (-F.col("best.c")).alias("chan"), (-F.col("best.v")).alias("cut")), ["image_id", "node"])


def _greedy(rows: list[dict], k: int, target: float) -> tuple[dict[int, int], list[int]]:
    """Box numbers of the leaves after splitting, always the box whose split removes most error (then the one made first), until ``k`` boxes or the error is at most ``target`` a pixel; and the
    boxes it would split whose halves aren't known yet."""
    known = {r["node"]: r for r in rows}
    root = known[0]
    error, made = root["error"], 1
    heap, leaves, wanted = [(-root["gain"], 0, 0)], {0: 0}, []
    while heap and made < k and error > target * root["n"]:
        lost, box, node = heapq.heappop(heap)
        if lost >= 0:
            break
        error, made = error + lost, made + 1
        if known[node]["left"] < 0:
            wanted.append(node)
            continue
        del leaves[node]
        for child, number in ((known[node]["left"], box), (known[node]["left"] + 1, made - 1)):
            leaves[child] = number
            heapq.heappush(heap, (-known[child]["gain"], number, child))
    return leaves, wanted


def _best_cut(rgb: np.ndarray, n: np.ndarray) -> tuple[float, float, int, int]:
    """(error, gain, chan, cut) of one box, in the arithmetic of :func:`_best_splits`."""
    at = (rgb + [0, 256, 512]).ravel()
    there = np.bincount(at, minlength=768).reshape(3, 256) > 0
    left = [np.bincount(at, np.repeat(w, 3), 768).reshape(3, 256).cumsum(axis=1) for w in (n, *(n * rgb[:, c] for c in range(3)))]
    ln, tn = left[0], left[0][0, -1]
    right = tn - ln
    a, b, c = (right * ls - ln * (ls[0, -1] - ls) for ls in left[1:])
    gain = np.where(there, 0.0, -1.0)
    inside = there & (right > 0)
    gain[inside] = (a * a + b * b + c * c)[inside] / (tn * ln * right)[inside]
    best = int(gain.argmax())
    sr, sg, sb = (float(ls[0, -1]) for ls in left[1:])
    return float((n * (rgb * rgb).sum(axis=1)).sum()) - (sr * sr + sg * sg + sb * sb) / tn, float(gain.flat[best]), best // 256, best % 256


def _split_image(rgb: np.ndarray, n: np.ndarray, k: int, target: float) -> np.ndarray:
    """Box numbers of one image's colours, in the order of :func:`_greedy`."""
    box = np.zeros(len(n), np.int64)
    error, gain, chan, cut = _best_cut(rgb, n)
    heap, made, enough = [(-gain, 0, np.arange(len(n)), chan, cut)], 1, target * int(n.sum())
    while heap and made < k and error > enough:
        lost, number, own, chan, cut = heapq.heappop(heap)
        if lost >= 0:
            break
        error, made = error + lost, made + 1
        high = rgb[own, chan] > cut
        box[own[high]] = made - 1
        for part, name in ((own[~high], number), (own[high], made - 1)):
            _, gain, chan, cut = _best_cut(rgb[part], n[part])
            heapq.heappush(heap, (-gain, name, part, chan, cut))
    return box


def variance_split(hist: DataFrame, k: int, target: float = 0.0) -> DataFrame:
    """``hist`` with ``box``: best-first splitting by the squared error a split removes, up to k boxes, or until the error a pixel is at most ``target``, so that an easy image gets a smaller palette.

    Images of at most WHOLE_COLORS colours are solved in one pass, a call each; larger ones go through :func:`_split_rounds`, which gives the same boxes.
    """
    kind = dict(hist.dtypes)["image_id"]

    def solve(colors: pa.Table) -> pa.Table:
        return colors.append_column("box", pa.array(_split_image(*_numbers(colors), k, target)))

    small, large = _by_size(hist)
    out = small.groupBy("image_id").applyInArrow(solve, f"image_id {kind}, r int, g int, b int, n long, box long")
    return out if large is None else out.unionByName(_split_rounds(large, k, target))


def _split_rounds(hist: DataFrame, k: int, target: float) -> DataFrame:
    """:func:`variance_split` of images of any size.

    The order of splits is one of a whole image, their search is not: a round finds the best cuts of all boxes that the order may want next, for all images at once; a walk over the at most few
    hundred boxes known of an image then says which boxes come next. There are about as many rounds as the tree of boxes is deep. Colours stay distributed and move with their box.
    """
    kind = dict(hist.dtypes)["image_id"]
    colors = cut_lineage(hist.select("image_id", *RGB, "n", F.lit(0).alias("node")))
    fresh = colors
    tree = None

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        leaves, wanted = _greedy(rows, k, target)
        if wanted:
            first = max(r["node"] for r in rows) + 1
            out = [(r["image_id"], r["node"], first + 2 * wanted.index(r["node"]) if r["node"] in wanted else r["left"], -1) for r in rows]
        else:
            box, known = {}, {r["node"]: r for r in rows}
            for leaf, number in leaves.items():
                todo = [leaf]
                while todo:
                    node = todo.pop()
                    box[node] = number
                    if known[node]["left"] >= 0:
                        todo += [known[node]["left"], known[node]["left"] + 1]
            out = [(r["image_id"], r["node"], r["left"], box.get(r["node"], -1)) for r in rows]
        return pd.DataFrame(out, columns=["image_id", "node", "left", "box"])

    while True:
        found = _best_splits(fresh).withColumn("left", F.lit(-1))
        tree = cut_lineage(found if tree is None else tree.unionByName(found))
        steps = cut_lineage(tree.groupBy("image_id").applyInPandas(walk, f"image_id {kind}, node int, left int, box int"))
        grown = tree.withColumnRenamed("left", "_old").join(steps, ["image_id", "node"])
        if not grown.where("left <> _old").limit(1).collect():
            break
        splits = grown.where("left <> _old").select("image_id", "node", "chan", "cut", F.col("left").alias("_left"))
        tree = cut_lineage(grown.drop("_old", "box"))
        value = F.when(F.col("chan") == 0, F.col("r")).when(F.col("chan") == 1, F.col("g")).otherwise(F.col("b"))
        moved = colors.join(splits, ["image_id", "node"], "left").withColumn("node", F.coalesce(F.col("_left") + (value > F.col("cut")).cast("int"), F.col("node")))
        moved = cut_lineage(moved.select("image_id", *RGB, "n", "node", F.col("_left").isNotNull().alias("fresh")))
        colors, fresh = moved.drop("fresh"), moved.where("fresh").drop("fresh")
    return colors.join(steps.select("image_id", "node", F.col("box").cast("long").alias("box")), ["image_id", "node"]).drop("node")


def quality_bounded(hist: DataFrame, k: int, floor: float = 85, enough: float = 100, rounds: int = ERROR_WEIGHTED_ROUNDS) -> dict[str, DataFrame]:
    """Best-first boxes refined by Lloyd rounds, with as few colours as the quality ``enough`` needs; an image that stays below the quality ``floor`` with k colours gets the median cut instead.

    ``quality`` has (image_id, mse, fell_back): the refined palette's mean squared error a pixel and whether it was given up.
    """
    hist = cut_lineage(hist)
    boxes = variance_split(hist, k, quality_error(enough))
    palette = _with_dense_idx(boxes.groupBy("image_id", "box").agg(*[_mean(c) for c in RGB]))
    palette = lloyd(hist, cut_lineage(palette.select("image_id", "idx", *RGB)), rounds)
    mapped = _assigned(hist, palette)
    entries = palette.withColumnsRenamed({c: f"p{c}" for c in RGB})
    apart = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in RGB[1:]), (F.col("r") - F.col("pr")) * (F.col("r") - F.col("pr")))
    mse = mapped.join(entries, ["image_id", "idx"]).groupBy("image_id").agg((F.sum(apart * F.col("n")) / F.sum("n")).alias("mse"))
    quality = cut_lineage(mse.withColumn("fell_back", F.col("mse") > quality_error(floor)))
    failed = quality.where("fell_back").select("image_id")
    if not failed.limit(1).collect():
        return {**_result(palette, mapped), "quality": quality}
    plain = median_cut(hist.join(failed, "image_id", "left_semi"), k)
    good = _result(palette, mapped)
    return {name: df.join(failed, "image_id", "left_anti").unionByName(plain[name]) for name, df in good.items()} | {"quality": quality}


def uniform(hist: DataFrame, k: int) -> dict[str, DataFrame]:
    """Median cut of the median-cut image."""
    once = median_cut(hist, k)
    flat = once["color_map"].join(hist, ["image_id", *RGB]).drop(*RGB).join(once["palette"], ["image_id", "idx"])
    again = median_cut(flat.groupBy("image_id", *RGB).agg(F.sum("n").alias("n")), k)
    return _nearest(hist, again["palette"])


def _picks(cells: list[dict], chosen: list[tuple], k: int) -> tuple[list[tuple], set[int]]:
    """Further farthest colours that are certain from what cells tell; if they don't suffice, the cells that must be looked into for the next one: those whose farthest colour came nearer.

    A cell tells its farthest colour and its reach at the last look. A pick since then leaves the reach of a cell as it was if its farthest colour keeps it; else the old reach, and the distance from the pick to the far corner of the
    cell, bound it from above.
    """
    if not cells:
        return [], set()
    place = np.array([[c["cr"], c["cg"], c["cb"]] for c in cells], np.int64) * CELL
    told = np.array([[c["r"], c["g"], c["b"]] for c in cells], np.int64)
    reach = np.array([c["reach"] for c in cells], np.int64)
    own, upper, alone = reach, reach, np.array([c["colors"] for c in cells]) == 1
    rank = np.lexsort((told[:, 2], told[:, 1], told[:, 0], -np.array([c["n"] for c in cells], np.int64)))
    prior = np.empty(len(cells), np.int64)
    prior[rank] = np.arange(len(cells))
    new: list[tuple] = []
    while len(chosen) + len(new) < k:
        top = int(upper.max())
        if top == 0:
            break
        first = np.flatnonzero(upper == top)
        unsure = first[own[first] < top]
        if len(unsure):
            return new, set(np.flatnonzero(own < reach).tolist())
        best = int(first[np.argmin(prior[first])])
        pick = told[best]
        new.append(tuple(pick.tolist()))
        own = np.minimum(own, ((told - pick) ** 2).sum(axis=1))
        corner = np.maximum(np.abs(place - pick), np.abs(place + CELL - 1 - pick))
        upper = np.where(alone, own, np.maximum(own, np.minimum(upper, (corner**2).sum(axis=1))))
    return new, set()


def _farthest(rgb: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The farthest colours of one image in their order."""
    rgb = rgb[np.lexsort((rgb[:, 2], rgb[:, 1], rgb[:, 0], -n))].astype(np.int32)
    picks, reach = [0], ((rgb - rgb[0]) ** 2).sum(axis=1)
    while len(picks) < k and reach.max() > 0:
        picks.append(int(reach.argmax()))
        reach = np.minimum(reach, ((rgb - rgb[picks[-1]]) ** 2).sum(axis=1))
    return rgb[picks]


def max_coverage(hist: DataFrame, k: int) -> dict[str, DataFrame]:
    """Farthest-point palette: start from the most frequent colour, then always the colour farthest from all chosen; of equals the more frequent one, then the first by (r, g, b).

    Images of at most WHOLE_COLORS colours are solved in one pass, a call each; larger ones go through :func:`_farthest_rounds`, which makes the same picks.
    """
    kind = dict(hist.dtypes)["image_id"]

    def solve(colors: pa.Table) -> pa.Table:
        found = _farthest(*_numbers(colors), k)
        parts = [colors.column("image_id").combine_chunks().take(pa.array(np.zeros(len(found), np.int64))), *[pa.array(found[:, i]) for i in range(3)], pa.array(range(len(found)), pa.int32())]
        return pa.table(parts, ["image_id", *RGB, "box"])

    small, large = _by_size(hist)
    box = small.groupBy("image_id").applyInArrow(solve, f"image_id {kind}, r int, g int, b int, box int")
    if large is not None:
        box = box.unionByName(_farthest_rounds(large, k))
    return _nearest(hist, cut_lineage(_with_dense_idx(box)))


def _farthest_rounds(hist: DataFrame, k: int) -> DataFrame:
    """(image_id, r, g, b, box): the picks of :func:`max_coverage` in images of any size.

    A table of cells, 8 values wide a channel (at most 32768 an image), keeps each cell's farthest colour. A round looks into the cells whose farthest colour came nearer, with partial aggregation over their
    colours; then a walk over an image's cells makes all picks that are certain, and ends when a cell's bound beats the best of them. The histogram stays distributed and no colour is left out of the search.
    """
    kind = dict(hist.dtypes)["image_id"]
    at = [F.floor(F.col(c) / CELL).cast("int").alias(f"c{c}") for c in RGB]
    colors = cut_lineage(hist.select("image_id", *RGB, "n", *at))
    cell = ["image_id", "cr", "cg", "cb"]
    order = F.struct(F.col("n"), *[(-F.col(c)).alias(c) for c in RGB])
    start = colors.groupBy("image_id").agg(F.max(order).alias("m")).select("image_id", F.array(F.struct(*[(-F.col(f"m.{c}")).alias(c) for c in RGB])).alias("chosen"))
    chosen, opened, cells = cut_lineage(start), colors, None
    picks = "array<struct<r:int,g:int,b:int>>"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        have = [(c["r"], c["g"], c["b"]) for c in pdf["chosen"].iloc[0]]
        new, look = _picks(pdf.drop(columns="chosen").to_dict("records"), have, k)
        row = [(pdf["image_id"].iloc[0], [dict(zip(RGB, p)) for p in have + new], [int(i) for i in pdf.iloc[sorted(look)]["id"]], bool(look))]
        return pd.DataFrame(row, columns=["image_id", "chosen", "look", "more"])

    while True:
        reach = F.array_min(F.transform("chosen", lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in RGB[1:]), (F.col("r") - p["r"]) * (F.col("r") - p["r"]))))
        far = F.max(F.struct(reach.cast("long").alias("reach"), order.alias("o"))).alias("m")
        seen = opened.join(chosen, "image_id").groupBy(*cell).agg(far, F.count("*").alias("colors"))
        seen = seen.select(*cell, F.col("m.reach").alias("reach"), F.col("m.o.n").alias("n"), *[(-F.col(f"m.o.{c}")).alias(c) for c in RGB], "colors")
        seen = seen.withColumn("id", F.col("cr") * 65536 + F.col("cg") * 256 + F.col("cb"))
        if cells is not None:
            seen = seen.unionByName(cells.join(seen.select(*cell), cell, "left_anti"))
        cells = cut_lineage(seen)
        told = cut_lineage(cells.join(chosen, "image_id").groupBy("image_id").applyInPandas(walk, f"image_id {kind}, chosen {picks}, look array<int>, more boolean"))
        chosen = told.select("image_id", "chosen")
        if not told.where("more").limit(1).collect():
            break
        look = told.where("more").select("image_id", F.explode("look").alias("id"))
        look = look.select("image_id", F.shiftright("id", 16).alias("cr"), (F.shiftright("id", 8) % 256).alias("cg"), (F.col("id") % 256).alias("cb"))
        opened = colors.join(look, cell, "left_semi")
    return chosen.select("image_id", F.posexplode("chosen").alias("box", "p")).select("image_id", "p.*", "box")


def quantize_histogram(hist: DataFrame, method: str, k: int) -> dict[str, DataFrame]:
    run = {
        "max_coverage": max_coverage,
        "fast_octree": fast_octree,
        "libimagequant": quality_bounded,
        "kmeans_adaptive": kmeans_adaptive,
        "uniform": uniform,
    }.get((method or "").lower(), median_cut)
    return run(hist, k)


def quantize(px: DataFrame, method: str = "libimagequant", k: int = 64, post: str | None = "median") -> dict[str, DataFrame]:
    """Palette, colour map, histogram and index image (``image_id, x, y, idx, a``), smoothed unless ``post`` is None."""
    hist = cut_lineage(color_histogram(px, ["image_id"]))
    out = quantize_histogram(hist, method, k)
    out["color_map"] = cut_lineage(out["color_map"])
    idx = px.join(by_color(out["color_map"]), ["image_id", *RGB]).select("image_id", "x", "y", "idx", "a")
    if post and post != "none":
        smooth = smooth_dither(idx, k, post)
        idx = smooth.join(idx.select("image_id", "x", "y", "a"), ["image_id", "x", "y"])
    return {**out, "index_image": idx, "hist": hist}
