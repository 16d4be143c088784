"""Neighbourhood operators over scan-lines.

A pixel table is packed once into scan-lines (one array per line) inside bands of 256 lines; the lines next to a band
edge are copied into the band beyond it (halo). One shuffle on (image_id, band) then feeds the packing and the vertical
look-around, and one huge image is spread over many bands. Lines are taken as runs of x; holes inside a line are nulls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import color

BAND = 256
LANES = ["image_id", "band"]
#: From this reach on a median slides a histogram instead of sorting the taps of each pixel.
WIDE_REACH = 3
#: Histogram cells (columns x values) that a sliding median holds at once.
MEDIAN_CELLS = 1 << 20


def scan_lines(px: DataFrame, value: Column, halo: int, height_wrap: bool = False) -> DataFrame:
    """``image_id, band, y, x0, vals``: each band holds its own lines and ``halo`` lines on both sides.

    With ``height_wrap`` the image continues from its last line to its first; ``y`` is then the unwrapped line number.
    Images no taller than one band with its halo stay whole (``_whole``, one band, no copies).
    """
    y = F.col("y")
    if height_wrap:
        size = px.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
        px = px.join(size, "image_id").withColumn("_whole", F.col("_h") <= BAND + 2 * halo)
        # copies of the line one image height above and below, as often as the halo reaches; none for a whole image
        turns = F.when(F.col("_whole"), 0).otherwise(F.ceil(F.lit(halo) / F.col("_h"))).cast("int")
        px = px.withColumn("yy", F.explode(F.transform(F.sequence(-turns, turns), lambda k: y + k * F.col("_h"))))
        px = px.where(F.col("_whole") | F.col("yy").between(-halo, F.col("_h") - 1 + halo))
        line, keep = F.col("yy"), ["_h", "_w", "_whole"]
        last_band = F.when(F.col("_whole"), 0).otherwise(F.floor((F.col("_h") - 1) / BAND))
    else:
        px = px.withColumn("yy", y)
        line, keep, last_band = F.col("yy"), [], F.floor((y + halo) / BAND)
    low, high = F.floor((line - halo) / BAND), F.floor((line + halo) / BAND)
    if height_wrap:
        low = F.when(F.col("_whole"), 0).otherwise(low)
    bands = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, last_band).cast("int"))
    spread = px.select("image_id", F.explode(bands).alias("band"), "yy", "x", value.alias("v"), *keep)
    packed = (
        spread.repartition(*LANES)
        .groupBy(*LANES, "yy", *keep)
        .agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("run"))
    )
    x0, n = F.element_at("run", 1)["x"], F.size("run")
    last = F.element_at("run", -1)["x"]
    dense = F.transform("run", lambda e: e["v"])
    by_x = F.map_from_entries("run")
    holes = F.transform(F.sequence(x0, last), lambda x: F.element_at(by_x, x))
    vals = F.when(last - x0 + 1 == n, dense).otherwise(holes)
    return packed.select(*LANES, F.col("yy").alias("y"), *keep, x0.alias("x0"), vals.alias("vals"))


def _line(shift: int) -> Column:
    """The line ``shift`` lines away; past the image edge the last line there is repeated."""
    w = Window.partitionBy(*LANES).orderBy("y")
    near = F.struct("x0", "vals")
    out = near
    for k in range(1, abs(shift) + 1):
        step = F.lag(near, k) if shift < 0 else F.lead(near, k)
        out = F.coalesce(step.over(w), out)
    return out


def _at(line: Column, x: Column) -> Column:
    """Value of a packed line at ``x``, its ends repeated outwards."""
    pos = F.greatest(F.lit(0), F.least(F.size(line["vals"]) - 1, x - line["x0"]))
    return F.element_at(line["vals"], (pos + 1).cast("int"))


def _spread(lines: DataFrame, result: Column, out: str) -> DataFrame:
    """Own lines of each band back to one row per pixel; holes stay out."""
    own = lines.where(F.floor(F.col("y") / BAND) == F.col("band"))
    cells = own.select("image_id", "y", "x0", "vals", F.posexplode(result).alias("_i", out))
    there = F.element_at("vals", F.col("_i") + 1).isNotNull()
    return cells.where(there).select("image_id", (F.col("x0") + F.col("_i")).alias("x"), "y", out)


def _xs() -> Column:
    return F.sequence(F.col("x0"), F.col("x0") + F.size("vals") - 1)


def _shifted(line: Column, dx: int) -> Column:
    """The part of a packed line that lies ``dx`` beside the current line, its ends repeated where it is shorter.

    Slices and repeats only, so a whole line moves at once and stays in generated code.
    """
    vals, n = line["vals"], F.size("vals")
    first, m = F.col("x0") + dx - line["x0"], F.size(line["vals"])
    before = F.greatest(F.lit(0), F.least(n, -first))
    start = F.greatest(first, F.lit(0))
    take = F.greatest(F.lit(0), F.least(n - before, m - start))
    head, tail = F.element_at(vals, 1), F.element_at(vals, -1)
    return F.concat(F.array_repeat(head, before), F.slice(vals, start + 1, take), F.array_repeat(tail, n - before - take))


def median_filter(index_image: DataFrame, size: int = 3, value: str = "idx") -> DataFrame:
    """size x size median of an index image, edges repeated; even counts (only beside holes) take the upper middle.

    Small windows sort their taps in generated code. Wide ones (reach of WIDE_REACH or more) slide a histogram per column down the
    lines of a band, so that a pixel costs the same whatever the window's size.
    """
    if size <= 1:
        return index_image.select("image_id", "x", "y", value)
    reach = size // 2
    if reach >= WIDE_REACH:
        return _sliding_median(index_image, reach, value)
    names = {f"_l{k + reach}": _line(k) for k in range(-reach, reach + 1)}
    lines = scan_lines(index_image, F.col(value), reach).withColumns(names)
    own = lines.where(F.floor(F.col("y") / BAND) == F.col("band"))
    taps = {f"t{i}{dx + reach}": _shifted(F.col(n), dx) for i, n in enumerate(names) for dx in range(-reach, reach + 1)}
    moved = own.select("image_id", "y", "x0", "vals", *[c.alias(n) for n, c in taps.items()])
    cells = moved.select("image_id", "y", "x0", F.posexplode(F.arrays_zip("vals", *taps)).alias("_i", "t"))
    around = F.array(*[F.col(f"t.{n}") for n in taps])
    known = sum((F.col(f"t.{n}").isNotNull().cast("int") for n in taps), F.lit(0))
    middle = F.element_at(F.sort_array(around), (F.lit(len(taps)) - known + F.floor(known / 2) + 1).cast("int"))
    return cells.where(F.col("t.vals").isNotNull()).select("image_id", (F.col("x0") + F.col("_i")).alias("x"), "y", middle.alias(value))


def sliding_median(lines: list[np.ndarray], starts: list[int], own: list[bool], reach: int) -> list[np.ndarray]:
    """Medians of the own lines (float arrays, NaN for holes, each beginning at its ``starts``), line and edge values repeated outwards.

    Each column keeps the counts of the values in its 2 reach + 1 lines: a step down adds a line's value and drops one. Sums of
    these counts along the line give the counts in the window of each pixel by one difference.
    """
    levels = np.unique(np.concatenate(lines))
    levels = levels[~np.isnan(levels)]
    out = [np.full(len(v), np.nan) for v, mine in zip(lines, own) if mine]
    if not len(levels):
        return out
    codes = [np.where(np.isnan(v), len(levels), np.searchsorted(levels, v)) for v in lines]  # a hole has a cell of its own
    left = min(s for s, mine in zip(starts, own) if mine)
    right = max(s + len(v) for v, s, mine in zip(lines, starts, own) if mine)
    step = max(1, MEDIAN_CELLS // (len(levels) + 1))
    last = len(lines) - 1
    for a in range(left, right, step):
        b = min(a + step, right)
        xs = np.arange(a - reach, b + reach)
        at = np.arange(len(xs))
        part = lambda i: codes[i][np.clip(xs - starts[i], 0, len(codes[i]) - 1)]
        counts = np.zeros((len(xs), len(levels) + 1), np.int32)
        for k in range(-reach, reach + 1):
            counts[at, part(min(max(k, 0), last))] += 1
        done = 0
        for i in range(len(lines)):
            if i:
                counts[at, part(min(i + reach, last))] += 1
                counts[at, part(max(i - reach - 1, 0))] -= 1
            if not own[i]:
                continue
            lo, hi = max(a, starts[i]), min(b, starts[i] + len(lines[i]))
            if lo < hi:
                sums = np.zeros((hi - lo + 2 * reach + 1, len(levels)), np.int32)
                np.cumsum(counts[lo - a : hi - a + 2 * reach, :-1], axis=0, out=sums[1:])
                upto = np.cumsum(sums[2 * reach + 1 :] - sums[: hi - lo], axis=1)
                middle = (upto <= (upto[:, -1] // 2)[:, None]).sum(axis=1)
                out[done][lo - starts[i] : hi - starts[i]] = levels[np.minimum(middle, len(levels) - 1)]
            done += 1
    return out


def _sliding_median(index_image: DataFrame, reach: int, value: str) -> DataFrame:
    """Wide medians, one band of lines (with its copied edge lines) per call."""
    lines = scan_lines(index_image, F.col(value).cast("double"), reach)
    kind = dict(index_image.dtypes)[value]

    def solve(band: pd.DataFrame) -> pd.DataFrame:
        band = band.sort_values("y")
        own = (band["y"] // BAND == band["band"]).tolist()
        medians = sliding_median([np.asarray(v, np.float64) for v in band["vals"]], band["x0"].tolist(), own, reach) if any(own) else []
        mine = band.loc[own, ["image_id", "y", "x0", "vals"]].astype({"vals": object})
        return mine.assign(_m=pd.Series(medians, index=mine.index, dtype=object))

    types = dict(lines.dtypes)
    schema = f"image_id {types['image_id']}, y {types['y']}, x0 {types['x0']}, vals array<double>, _m array<double>"
    found = lines.groupBy(*LANES).applyInPandas(solve, schema)
    cells = found.select("image_id", "y", "x0", F.posexplode(F.arrays_zip("vals", "_m")).alias("_i", "t"))
    there = F.col("t.vals").isNotNull() & ~F.isnan("t.vals")
    return cells.where(there).select("image_id", (F.col("x0") + F.col("_i")).alias("x"), "y", F.col("t._m").cast(kind).alias(value))


def gaussian_weights(sigma: float) -> list[float]:
    reach = math.ceil(3.0 * sigma)
    raw = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_filter(index_image: DataFrame, sigma: float = 0.6, value: str = "idx", whole: bool = True) -> DataFrame:
    """Separable true Gaussian (radius ceil(3 sigma)), edges repeated; ``whole`` rounds to the nearest index."""
    if sigma <= 0:
        return index_image.select("image_id", "x", "y", value)
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    lines = scan_lines(index_image, F.col(value).cast("double"), reach)
    flat = lambda x: sum(
        (_at(F.struct("x0", "vals"), x + k - reach) * w for k, w in enumerate(weights)), F.lit(0.0)
    )
    smooth = lines.withColumn("_h", F.transform(_xs(), flat))
    own = smooth.withColumn("_raw", F.col("vals")).withColumn("vals", F.col("_h")).drop("_h")
    names = {f"_l{k + reach}": _line(k) for k in range(-reach, reach + 1)}
    tall = own.withColumns(names).withColumn("vals", F.col("_raw"))

    def blur(x: Column) -> Column:
        v = sum((_at(F.col(n), x) * w for n, w in zip(names, weights)), F.lit(0.0))
        return F.floor(F.round(v, 6) + 0.5).cast("int") if whole else v

    return _spread(tall, F.transform(_xs(), blur), value)


def bayer_filter(index_image: DataFrame, size: int, amount: float = 0.2) -> DataFrame:
    moved = color.bayer_dither(F.col("idx"), F.col("x"), F.col("y"), size, amount)
    return index_image.select("image_id", "x", "y", moved.alias("idx"))


def smooth_dither(
    index_image: DataFrame, size: int, method: str = "median", median_size: int = 3, sigma: float = 0.6, amount: float = 0.2
) -> DataFrame:
    """none, median, gaussian, dither, median_dither or gaussian_dither; unknown names mean median. Clipped to the palette."""
    method = (method or "median").lower()
    out = index_image.select("image_id", "x", "y", "idx")
    if method.startswith("gaussian"):
        out = gaussian_filter(out, sigma)
    elif method not in ("none", "dither"):
        out = median_filter(out, median_size)
    if method in ("dither", "median_dither", "gaussian_dither"):
        out = bayer_filter(out, size, amount)
    return out.withColumn("idx", F.greatest(F.lit(0), F.least(F.col("idx"), F.lit(max(1, size - 1)))))


def cooccurrence(index_image: DataFrame, connectivity: int = 8, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """How often two unlike indices touch, counted both ways: ``by, idx_a, idx_b, n``.

    Each pixel looks right, down and (8-way) to both lower diagonals. Pairs come out of packed lines and are counted
    before any shuffle.
    """
    lines = scan_lines(index_image, F.col("idx"), 1)
    w = Window.partitionBy(*LANES).orderBy("y")
    below = F.lead(F.struct("y", "x0", "vals")).over(w)
    lines = lines.withColumn("_b", F.when(below["y"] == F.col("y") + 1, below))
    own = lines.where(F.floor(F.col("y") / BAND) == F.col("band"))
    looks = (-1, 0, 1) if connectivity == 8 else (0,)

    def links(line: Column, dx: int) -> Column:
        """Values of this line zipped with those of ``line`` at ``dx`` beside them, over the columns both have."""
        x0, n, ox, m = F.col("x0"), F.size("vals"), line["x0"], F.size(line["vals"])
        lo = F.greatest(x0, ox - dx)
        width = F.greatest(F.lit(0), F.least(x0 + n, ox + m - dx) - lo)
        return F.arrays_zip(
            F.slice("vals", F.greatest(lo - x0 + 1, F.lit(1)), width).alias("a"),
            F.slice(line["vals"], F.greatest(lo + dx - ox + 1, F.lit(1)), width).alias("b"),
        )

    none = F.array().cast("array<struct<a:int,b:int>>")
    found = [links(F.struct("x0", "vals"), 1), *[F.coalesce(links(F.col("_b"), dx), none) for dx in looks]]
    pairs = own.select("image_id", F.explode(F.concat(*found)).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    unlike = pairs.where(a != b).groupBy(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = unlike.select(*by, F.explode(ways).alias("p"), "n")
    return both.select(*by, F.col("p.a").alias("idx_a"), F.col("p.b").alias("idx_b"), "n")


# fixed values: neighbour order of the fill, as (dx, dy) shifts of the known area
FILL_SHIFTS = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))


def dilate(px: DataFrame, max_iters: int = 64) -> DataFrame:
    """Fill clear pixels from their neighbours, coordinates wrap, filled pixels become opaque.

    In a round the eight shifts run in a fixed order and each uses what the shift before has filled, so the fill moves at
    most three lines per round. Every band therefore carries 3 * max_iters halo lines and is exact on its own: one
    shuffle in all, no iteration over shuffles. Missing pixels neither spread nor fill.
    """
    argb = color.pack_rgb(F.col("r"), F.col("g"), F.col("b")).cast("long") + F.col("a").cast("long") * 16777216
    lines = scan_lines(px, argb, 3 * max_iters, height_wrap=True)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        band, width, height = (int(pdf[c].iloc[0]) for c in ("band", "_w", "_h"))
        whole = bool(pdf["_whole"].iloc[0])
        top = 0 if whole else int(pdf["y"].iloc[0])
        rows = height if whole else int(pdf["y"].iloc[-1]) - top + 1
        grid = np.full((rows, width), -1, dtype=np.int64)
        for y, x0, vals in zip(pdf["y"], pdf["x0"], pdf["vals"]):
            line = np.array([-1 if v is None or v != v else v for v in vals], dtype=np.int64)
            grid[y - top, x0 : x0 + len(line)] = line
        rgb, alpha = grid & 0xFFFFFF, grid >> 24
        known, wanted = (grid >= 0) & (alpha > 0), (grid >= 0) & (alpha == 0)
        for _ in range(max_iters):
            moved = False
            for dx, dy in FILL_SHIFTS:
                reach = np.roll(np.roll(known, dx, axis=1), dy, axis=0) & wanted
                if reach.any():
                    rgb = np.where(reach, np.roll(np.roll(rgb, dx, axis=1), dy, axis=0), rgb)
                    known, wanted, moved = known | reach, wanted & ~reach, True
            if not moved:
                break
        line = np.arange(rows) + top
        own = (line >= 0) & (line < height) & (whole | (line // BAND == band))
        ys, xs = np.nonzero((grid >= 0) & own[:, None])
        c = rgb[ys, xs]
        filled = (alpha == 0) & known
        a = np.where(filled, 255, alpha)[ys, xs]
        out = {"image_id": pdf["image_id"].iloc[0], "x": xs, "y": ys + top, "r": c >> 16, "g": (c >> 8) & 255, "b": c & 255, "a": a}
        return pd.DataFrame(out)

    kind = dict(px.dtypes)["image_id"]
    return lines.groupBy(*LANES).applyInPandas(fill, f"image_id {kind}, x int, y int, r int, g int, b int, a int")
