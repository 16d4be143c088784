"""Aggregations over pixel tables, index images and palettes.

Pixel table: ``image_id, x, y, r, g, b, a``. Index image: ``image_id, x, y, idx``. Palette: ``palette_id, idx, r, g, b``.
Every aggregation here is a partial-then-final hash aggregation, so a hot image shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import color
from texelmill.functions.tokens import range_text

RGB = ["r", "g", "b"]
RGBPoint = tuple[int, int, int]
DISPLAY_LEVELS = 256
FILLER_FRACTION = 0.9  # fixed value: a palette scan-line this grey is filler


def color_histogram(px: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pixels per colour, optionally per ``by`` columns."""
    return px.groupBy(*by, *RGB).agg(F.count(F.lit(1)).alias("n"))


def unique_colors(px: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return px.select(*by, *RGB).distinct()


def color_coverage(px: DataFrame, palettes: DataFrame | None = None) -> DataFrame:
    """Pixels and distinct images per colour. Palette colours seen in no image get ``n = 1, coverage = 0``."""
    per_image = color_histogram(px, ["image_id"])
    seen = per_image.select(*RGB, "n", F.lit(1).alias("cov"))
    if palettes is not None:
        seen = seen.unionByName(unique_colors(palettes).select(*RGB, F.lit(0).cast("long").alias("n"), F.lit(0).alias("cov")))
    out = seen.groupBy(*RGB).agg(F.sum("n").alias("n"), F.sum("cov").alias("coverage"))
    return out.select(*RGB, F.greatest("n", F.lit(1)).alias("n"), "coverage")


def grey_histogram(index_image: DataFrame) -> DataFrame:
    return index_image.groupBy("image_id", "idx").agg(F.count(F.lit(1)).alias("n"))


def grey_summary(index_image: DataFrame) -> DataFrame:
    """Pixels, distinct values, share of the 256 levels in percent, lowest and highest value per image."""
    return (
        grey_histogram(index_image)
        .groupBy("image_id")
        .agg(
            F.sum("n").alias("pixels"),
            F.count(F.lit(1)).alias("unique_values"),
            F.min("idx").alias("min_value"),
            F.max("idx").alias("max_value"),
        )
        .withColumn("coverage_pct", F.col("unique_values") / float(DISPLAY_LEVELS) * 100.0)
    )


def _ranges(values: DataFrame, out: str) -> DataFrame:
    """Distinct (image_id, idx) to one text of ``a-b`` islands; at most 256 values per image."""
    w = Window.partitionBy("image_id").orderBy("idx")
    islands = (
        values.withColumn("_island", F.col("idx") - F.row_number().over(w))
        .groupBy("image_id", "_island")
        .agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    return islands.groupBy("image_id").agg(
        F.array_join(F.transform(ordered, lambda s: range_text(s["lo"], s["hi"])), ", ").alias(out)
    )


def index_ranges(index_image: DataFrame) -> DataFrame:
    """Present and missing index ranges of 0..255 per image."""
    present = index_image.select("image_id", "idx").distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(DISPLAY_LEVELS - 1))).alias("idx")
    absent = present.select("image_id").distinct().select("image_id", levels).join(present, ["image_id", "idx"], "left_anti")
    return (
        _ranges(present, "present_ranges")
        .join(_ranges(absent, "missing_ranges"), "image_id", "left")
        .withColumn("missing_ranges", F.coalesce("missing_ranges", F.lit("(none)")))
    )


def dominant_color(indexed: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Most frequent colour per index with its pixel counts; equal counts go to the smallest (r, g, b)."""
    packed = color.pack_rgb(F.col("r"), F.col("g"), F.col("b"))
    per_color = indexed.groupBy(*by, "idx", packed.alias("rgb")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("rgb", "n"), F.struct("n", -F.col("rgb")))
    top = per_color.groupBy(*by, "idx").agg(best.alias("best"), F.sum("n").alias("pixels"))
    parts = color.unpack_rgb(F.col("best.rgb"))
    return top.select(*by, "idx", *[c.alias(k) for k, c in parts.items()], F.col("best.n").alias("n"), "pixels")


def top_colors(indexed: DataFrame, k: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """The ``k`` most frequent colours per index (the report lines of a rebuilt palette row)."""
    per_color = indexed.groupBy(*by, "idx", *RGB).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "idx").orderBy(F.desc("n"), *RGB)
    return per_color.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representative_grey(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median grey per group, truncated. ``percentile`` keeps counts per value, never the rows."""
    return pairs.groupBy(*by).agg(F.percentile("grey", F.lit(0.5)).cast("int").alias("repr_grey"))


def color_report(palette: DataFrame, hist: DataFrame, top: int = 10) -> DataFrame:
    """Per palette entry: colour, pixels and share of the image, with its place among most and least used.

    ``palette``: image_id, idx, r, g, b (at most 256 entries per image); ``hist``: image_id, r, g, b, n.
    """
    totals = hist.groupBy("image_id").agg(F.sum("n").alias("total"))
    joined = (
        palette.join(hist, ["image_id", *RGB], "left")
        .join(totals, "image_id", "left")
        .withColumn("frequency", F.coalesce("n", F.lit(0).cast("long")))
    )
    w = Window.partitionBy("image_id")
    return joined.select(
        "image_id",
        "idx",
        *RGB,
        "frequency",
        (F.col("frequency") / F.col("total") * 100.0).alias("frequency_pct"),
        (F.row_number().over(w.orderBy(F.desc("frequency"), "idx")) <= top).alias("most_used"),
        (F.row_number().over(w.orderBy(F.asc("frequency"), "idx")) <= top).alias("least_used"),
    )


def suffix_counts(stems: DataFrame, stem_col: Column) -> DataFrame:
    low = F.lower(stem_col)
    return stems.agg(
        F.count_if(F.endswith(low, F.lit("_d"))).alias("d_count"), F.count_if(F.endswith(low, F.lit("_n"))).alias("n_count")
    )


def used_palette(index_image: DataFrame, palette: DataFrame) -> DataFrame:
    """Palette rows 0..highest index used by each image (``image_id`` joins on the palette's ``image_id``)."""
    top = index_image.groupBy("image_id").agg(F.max("idx").alias("max_idx"))
    return palette.join(top, "image_id").where(F.col("idx") <= F.col("max_idx")).select("image_id", "idx", *RGB)


def with_transparency(px: DataFrame) -> DataFrame:
    """Only the images that hold at least one pixel with alpha below 255."""
    clear = px.where(F.col("a") < 255).select("image_id").distinct()
    return px.join(clear, "image_id", "left_semi")


def frac_grey(scan_lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of r=g=b texels per palette scan-line, and whether the line is grey filler."""
    grey = ((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).cast("int")
    out = scan_lines.groupBy(*by).agg(F.avg(grey).alias("frac_grey"))
    return out.withColumn("is_filler", F.col("frac_grey") >= FILLER_FRACTION)


def path_continuity(ordered: DataFrame) -> DataFrame:
    """Total, mean and largest CIE76 step along each palette in ``position`` order (at most 256 rows each)."""
    w = Window.partitionBy("palette_id").orderBy("position")
    lab = color.with_lab(ordered)
    prev = {f"_p{c}": F.lag(c).over(w) for c in ("lab_l", "lab_a", "lab_b")}
    here = [F.col(c) for c in ("lab_l", "lab_a", "lab_b")]
    steps = lab.withColumns(prev).withColumn("step", color.delta_e76(*here, *[F.col(c) for c in prev]))
    return steps.groupBy("palette_id").agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_de"),
        F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_de"),
        F.coalesce(F.max("step"), F.lit(0.0)).alias("max_de"),
    )


# ---- grey conversions ----------------------------------------------------------------------------------------


def _stretched(colors: DataFrame, value: str) -> DataFrame:
    """Min-max stretch of a per-colour value to 0..255 per image, truncated."""
    ends = colors.groupBy("image_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    grey = F.floor(F.round(unit * 255.0, 9)).cast("int")
    return colors.join(ends, "image_id").withColumn("grey", grey).select("image_id", *RGB, "grey")


def grey_linear(px: DataFrame) -> DataFrame:
    """Grey per (image, colour): linear-light luminance, stretched per image."""
    colors = unique_colors(px, ["image_id"])
    lum = color.linear_luminance(F.col("r"), F.col("g"), F.col("b"))
    return _stretched(colors.withColumn("_lum", lum), "_lum")


def grey_weighted_lab(px: DataFrame) -> DataFrame:
    """Grey per (image, colour): lightness plus 0.3 chroma in 8-bit Lab units, stretched per image."""
    lab = color.with_lab(unique_colors(px, ["image_id"]))
    value = F.col("lab_l") * 2.55 + color.chroma(F.col("lab_a"), F.col("lab_b")) * 0.3
    return _stretched(lab.withColumn("_w", value), "_w")


def grey_rank(px: DataFrame) -> DataFrame:
    """Grey per (image, colour): colours ranked by lightness and spread evenly over 0..255.

    The window holds the distinct colours of one image, never its pixels.
    """
    lab = color.with_lab(unique_colors(px, ["image_id"])).withColumn("_l", F.round("lab_l", 6))
    w = Window.partitionBy("image_id")
    rank = F.row_number().over(w.orderBy("_l", *RGB)) - 1
    last = F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return lab.select("image_id", *RGB, F.floor(rank * 255 / last).cast("int").alias("grey"))


def quantize_greys(px: DataFrame) -> DataFrame:
    """Replace each pixel's ``grey`` by the median grey of its colour in the image."""
    medians = representative_grey(px, ["image_id", *RGB])
    return px.join(medians, ["image_id", *RGB]).select("image_id", "x", "y", F.col("repr_grey").alias("grey"))


def palette_slots(indexed_greys: DataFrame, palette: DataFrame, size: int) -> DataFrame:
    """Build a ``size``-entry palette per image from representative greys.

    Slot = trunc(grey * (size-1) / 255); the lowest palette index wins a slot; gaps take the last filled slot before
    them, leading gaps the first filled slot.
    """
    greys = representative_grey(indexed_greys, ["image_id", "idx"])
    hits = greys.join(palette, ["image_id", "idx"]).withColumn(
        "slot", F.floor(F.col("repr_grey") * (size - 1) / 255).cast("int")
    )
    taken = hits.groupBy("image_id", "slot").agg(F.min_by(F.struct(*RGB), "idx").alias("c"))
    slots = taken.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    w = Window.partitionBy("image_id").orderBy("slot")
    before = F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = slots.join(taken, ["image_id", "slot"], "left").withColumn("c", F.coalesce(before, after))
    return filled.select("image_id", F.col("slot").alias("idx"), "c.r", "c.g", "c.b")


def first_appearance(px: DataFrame) -> DataFrame:
    """Distinct colours per image with the row-major position of their first pixel."""
    return px.groupBy("image_id", *RGB).agg(F.min(F.struct("y", "x")).alias("at")).select(
        "image_id", *RGB, F.col("at.y").alias("first_y"), F.col("at.x").alias("first_x")
    )
