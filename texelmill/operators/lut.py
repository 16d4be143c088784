"""Lookup-table construction: resampling, padding, row building, extraction and composition of palettes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import color
from texelmill.operators.histogram import FILLER_FRACTION, dominant_color, frac_grey
from texelmill.operators.mapping import packed_palette
from texelmill.operators.neighborhood import gaussian_weights

RGB = ["r", "g", "b"]
# ---- fixed values of the padding strategies ------------------------------------------------------------------
GRID_STEP = 42
BLEND_REACH = 4
BLEND_PARTS = 4
# --------------------------------------------------------------------------------------------------------------


def upscale_lut(palette: DataFrame, size: int = 256, sigma: float = 1.0, by: str = "palette_id") -> DataFrame:
    """Linear interpolation of each palette to ``size`` entries, then a reflect-padded Gaussian along the row.

    One row per palette: everything happens inside its arrays.
    """
    packed = packed_palette(palette, by)
    n = F.size("entries")

    def resampled(c: str) -> Column:
        vals = F.transform("entries", lambda e: e[c].cast("double"))

        def at(i: Column) -> Column:
            pos = i * (n - 1) / F.lit(float(size - 1))
            lo = F.least(F.floor(pos), n - 1).cast("int")
            hi = F.least(lo + 1, n - 1)
            left, right = F.element_at(vals, lo + 1), F.element_at(vals, hi + 1)
            return left + (right - left) * (pos - lo)

        return F.when(n == size, vals).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at))

    wide = packed.select(by, *[resampled(c).alias(c) for c in RGB])
    if sigma > 0:
        weights = gaussian_weights(sigma)
        reach = math.ceil(3.0 * sigma)
        last = size - 1

        def mirrored(i: Column) -> Column:
            j = F.abs(i)
            return F.when(j > last, 2 * last - j).otherwise(j)

        def smooth(c: str) -> Column:
            def one(i: Column) -> Column:
                return sum((F.element_at(c, mirrored(i + k - reach) + 1) * w for k, w in enumerate(weights)), F.lit(0.0))

            return F.transform(F.sequence(F.lit(0), F.lit(last)), one)

        wide = wide.select(by, *[smooth(c).alias(c) for c in RGB])
    rows = wide.select(by, F.posexplode(F.arrays_zip(*RGB)).alias("idx", "e"))
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.round(v, 6)).cast("int")))
    return rows.select(by, "idx", *[byte(F.col(f"e.{c}")).alias(c) for c in RGB])


def downsample_lut(palette: DataFrame, size: int, by: str = "palette_id") -> DataFrame:
    """Every palette's entries at trunc(linspace(0, 255, size)); missing source entries leave no row."""
    if size >= 256:
        return palette.select(by, "idx", *RGB)
    packed = packed_palette(palette, by)
    pick = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k")
    src = F.floor(F.col("k") * 255 / max(size - 1, 1)).cast("int")
    rows = packed.select(by, "entries", pick).withColumn("_s", F.filter("entries", lambda e: e["idx"] == src)[0])
    return rows.where(F.col("_s").isNotNull()).select(by, F.col("k").alias("idx"), *[F.col(f"_s.{c}").alias(c) for c in RGB])


def pad_palette(
    palette: DataFrame, size: int, by: str = "palette_id", hist: DataFrame | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """Fill each palette up to ``size`` colours. New colours come, in this order, from:

    0 ``candidates`` (by, seq, r, g, b); 1 quarter blends of entries i and i+1..i+4; 2 the most frequent colours of
    ``hist`` (by, r, g, b, n) that are missing; 3 an RGB grid of step 42 (343 colours, so every size up to 256 fills).
    A colour is taken once, from its first offer. New entries get the indices after the old ones.

    One row per palette: offers are arrays of packed colours in their order, never rows, so a task holds no more than its palettes.
    """
    n = F.size("entries")
    short = packed_palette(palette, by).where(F.col(by).isNotNull() & (n < size))
    packed = color.pack_rgb(*[F.col(c) for c in RGB])

    def first_offers(df: DataFrame, name: str, *order: Column) -> DataFrame:
        # at most 2 * size of them can matter: size palette colours may be among them
        place = F.row_number().over(Window.partitionBy(by).orderBy(*order, *RGB))
        first = df.select(by, *RGB, place.alias("_p")).where(F.col("_p") <= 2 * size)
        return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", packed.alias("c")))), lambda o: o["c"]).alias(name))

    def blend(one: Column, two: Column, k: Column) -> Column:
        return color.pack_rgb(*[F.floor((one[c] * (BLEND_PARTS - k) + two[c] * k) / BLEND_PARTS).cast("int") for c in RGB])

    def blends(i: Column) -> Column:
        one, parts = F.element_at("entries", i + 1), F.sequence(F.lit(1), F.lit(BLEND_PARTS - 1))
        near = F.filter(F.sequence(i + 1, i + BLEND_REACH), lambda j: j < n)
        return F.flatten(F.transform(near, lambda j: F.transform(parts, lambda k: blend(one, F.element_at("entries", j + 1), k))))

    steps = range(0, 256, GRID_STEP)
    grid = F.array(*[F.lit((r << 16) | (g << 8) | b) for r in steps for g in steps for b in steps])
    offers = [(1, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), blends))), (3, grid)]
    if candidates is not None:
        once = candidates.groupBy(by, *RGB).agg(F.min("seq").alias("seq"))
        short = short.join(first_offers(once, "_o0", F.col("seq")), by, "left")
        offers.append((0, F.col("_o0")))
    if hist is not None:
        short = short.join(first_offers(hist, "_o2", F.desc("n")), by, "left")
        offers.append((2, F.col("_o2")))
    new = short.withColumns({"_seen": F.transform("entries", lambda e: color.pack_rgb(*[e[c] for c in RGB])), "_new": F.array().cast("array<struct<c:int,s:int>>")})
    for strategy, colours in sorted(offers, key=lambda o: o[0]):
        new = new.withColumn("_fresh", F.array_except(F.coalesce(colours, F.array().cast("array<int>")), "_seen"))
        new = new.withColumns({"_seen": F.concat("_seen", "_fresh"), "_new": F.concat("_new", F.transform("_fresh", lambda c: F.struct(c.alias("c"), F.lit(strategy).alias("s"))))})
    added = new.select(by, n.alias("_n"), F.posexplode(F.slice("_new", F.lit(1), size - n)).alias("_p", "o"))
    return (
        palette.select(by, "idx", *RGB, F.lit(None).cast("int").alias("strategy"))
        .unionByName(added.select(by, (F.col("_n") + F.col("_p")).cast("int").alias("idx"), *[v.alias(k) for k, v in color.unpack_rgb(F.col("o.c")).items()], F.col("o.s").alias("strategy")))
        .where(F.col("idx") < size)
    )


def grey_index(px: DataFrame, size: int) -> DataFrame:
    """Palette index of a grey image: its red channel, clipped to the palette."""
    return px.withColumn("idx", F.least(F.col("r"), F.lit(size - 1)))


def nearest_pixels(grey: DataFrame, px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Give each grey pixel the colour at the same relative place of an image of another size (nearest)."""
    gsize = grey.groupBy(*keys).agg((F.max("x") + 1).alias("_gw"), (F.max("y") + 1).alias("_gh"))
    csize = px.groupBy(*keys).agg((F.max("x") + 1).alias("_cw"), (F.max("y") + 1).alias("_ch"))
    at = lambda p, c, g: F.floor((F.col(p) + 0.5) * F.col(c) / F.col(g)).cast("int")
    placed = grey.join(gsize.join(csize, list(keys)), list(keys)).withColumns({"_x": at("x", "_cw", "_gw"), "_y": at("y", "_ch", "_gh")})
    colors = px.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), *[F.col(c).alias(f"c_{c}") for c in RGB])
    return placed.join(colors, [*keys, "_x", "_y"]).select(*keys, "x", "y", "idx", *[F.col(f"c_{c}").alias(c) for c in RGB])


def build_row(indexed: DataFrame, base: DataFrame, by: str = "image_id", keep_close: bool = True, max_de: float = 2.0) -> DataFrame:
    """One palette row per ``by``: the dominant colour of each index, or the base colour.

    The base stays where an index has no pixels and, with ``keep_close``, where the dominant colour is within ``max_de``
    (CIEDE2000) of it. ``deviates`` marks replaced entries. ``base``: by, idx, r, g, b.
    """
    found = dominant_color(indexed, (by,)).withColumnsRenamed({c: f"d_{c}" for c in RGB})
    rows = base.select(by, "idx", *RGB).join(found, [by, "idx"], "left")
    lab = color.with_lab(rows, prefix="p_")
    lab = color.with_lab(lab.withColumns({f"_d{c}": F.coalesce(f"d_{c}", c) for c in RGB}), "_dr", "_dg", "_db", prefix="q_")
    lab = color.with_delta_e2000(lab, ("p_l", "p_a", "p_b"), ("q_l", "q_a", "q_b"), "delta_e")
    same = (F.col("r") == F.col("_dr")) & (F.col("g") == F.col("_dg")) & (F.col("b") == F.col("_db"))
    stay = same | (F.lit(keep_close) & (F.col("delta_e") <= max_de))
    return lab.select(
        by,
        "idx",
        *[F.when(stay, F.col(c)).otherwise(F.col(f"_d{c}")).alias(c) for c in RGB],
        (~stay).alias("deviates"),
        F.when(F.col("d_r").isNotNull(), F.col("delta_e")).alias("delta_e"),
        F.coalesce("pixels", F.lit(0).cast("long")).alias("pixels"),
    )


def extract_rows(texture: DataFrame, row_height: int) -> DataFrame:
    """Palette rows of palette textures: the first scan-line of each block unless it is grey filler.

    A texture without such a line gives its middle line. ``texture``: palette_id, x, y, r, g, b.
    """
    row_height = max(row_height, 1)
    height = texture.groupBy("palette_id").agg((F.max("y") + 1).alias("_h"))
    placed = texture.join(height, "palette_id")
    blocks = F.greatest(F.floor(F.col("_h") / row_height), F.lit(1))
    first_lines = placed.where((F.col("y") % row_height == 0) & (F.col("y") < blocks * row_height))
    shares = frac_grey(first_lines, ["palette_id", "y"]).where(F.col("frac_grey") < FILLER_FRACTION).select("palette_id", "y")
    good = first_lines.join(shares, ["palette_id", "y"], "left_semi")
    bare = height.join(shares, "palette_id", "left_anti").select("palette_id", F.floor(F.col("_h") / 2).alias("y"))
    rows = good.unionByName(placed.join(bare, ["palette_id", "y"], "left_semi").select(*good.columns))
    return rows.select("palette_id", F.floor(F.col("y") / row_height).cast("int").alias("row_no"), F.col("x").alias("idx"), *RGB)


def compose_palette(rows: DataFrame, row_height: int, pad: str = "none") -> DataFrame:
    """Stack palette rows into a texture, ``row_height`` scan-lines each, height padded to a power of two.

    ``rows``: palette_id, row_no (dense), idx, r, g, b. Padding is black, or a grey ramp with ``pad="gradient"``.
    """
    sizes = rows.groupBy("palette_id").agg((F.max("row_no") + 1).alias("_n"), (F.max("idx") + 1).alias("_w"))
    lines = F.sequence(F.col("row_no") * row_height, (F.col("row_no") + 1) * row_height - 1)
    body = rows.select("palette_id", F.explode(lines).alias("y"), F.col("idx").alias("x"), *RGB)
    full = color.next_power_of_2(F.col("_n") * row_height).cast("int")
    tail = sizes.withColumns({"_from": F.col("_n") * row_height, "_to": full}).where(F.col("_to") > F.col("_from"))
    pads = tail.select("palette_id", "_w", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("y")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x")
    )
    grey = color.index_to_display(F.col("x"), F.col("_w")) if pad == "gradient" else F.lit(0)
    return body.unionByName(pads.select("palette_id", "y", "x", *[grey.alias(c) for c in RGB]))
