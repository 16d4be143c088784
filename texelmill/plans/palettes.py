"""Whole palette workflows, composed of the operators. Every workflow runs for all images of a table in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import color
from texelmill.operators import cluster, histogram, lut, mapping, neighborhood, ordering, quantize
from texelmill.session import cut_lineage

RGB = ["r", "g", "b"]
# fixed values: default palette size and scan-lines per palette row
PALETTE_SIZE = 64
ROW_HEIGHT = 4


def _in_order(palette: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The lightness-ordered palette and the way from old to new indices."""
    sorted_ = ordering.lightness_sort(palette, by)
    return sorted_.select(by, F.col("position").alias("idx"), *RGB), sorted_.select(by, "idx", "position", *RGB)


def generate_palette(
    px: DataFrame,
    size: int = PALETTE_SIZE,
    method: str = "libimagequant",
    extras: DataFrame | None = None,
    quant_post: str | None = "median",
    grey_post: str | None = None,
    upscale_sigma: float | None = None,
    row_height: int = ROW_HEIGHT,
    textures: DataFrame | None = None,
    textures_post: bool = True,
) -> dict[str, DataFrame]:
    """One palette of exactly ``size`` colours per image, its grey index image, palette texture and colour report.

    ``textures`` (image_id, texture_no, x, y, r, g, b, a): further pictures that take the nearest entries of the image's palette, 0 where their own alpha is 0, smoothed by
    ``grey_post`` like the image unless ``textures_post`` is off; they come back as ``texture_images``.

    ``extras`` (image_id, extra_no from 1, x, y, r, g, b): further textures of the same layout, of any size; each adds a
    palette row.
    ``upscale_sigma`` widens palettes and indices to 256 levels.
    """
    q = quantize.quantize(px, method, size, quant_post)
    full = cut_lineage(lut.pad_palette(q["palette"].select("image_id", "idx", *RGB), size, "image_id", q["hist"]))
    palette, moves = _in_order(full, "image_id")
    grey = q["index_image"].join(moves.select("image_id", "idx", "position"), ["image_id", "idx"])
    grey = mapping.clear_transparent_index(grey.select("image_id", "x", "y", F.col("position").alias("idx"), "a"))
    if grey_post:
        smooth = neighborhood.smooth_dither(grey, size, grey_post)
        grey = mapping.clear_transparent_index(smooth.join(grey.drop("idx"), ["image_id", "x", "y"]))
    rows = palette.select(F.col("image_id").alias("palette_id"), F.lit(0).alias("row_no"), "idx", *RGB)
    if extras is not None:
        keyed = extras.withColumn("row_key", F.struct("image_id", "extra_no"))
        row_keys = keyed.select("image_id", "row_key").distinct()
        seen = lut.nearest_pixels(grey.select("image_id", "x", "y", "idx").join(row_keys, "image_id"), keyed, ("row_key",))
        bases = row_keys.join(palette, "image_id")
        built = lut.build_row(seen, bases, "row_key")
        rows = rows.unionByName(
            built.select(F.col("row_key.image_id").alias("palette_id"), F.col("row_key.extra_no").alias("row_no"), "idx", *RGB)
        )
    hist = q["hist"].join(mapping.by_color(q["color_map"]), ["image_id", *RGB])
    used = hist.groupBy("image_id", "idx").agg(F.sum("n").alias("n")).join(q["palette"], ["image_id", "idx"])
    used = cut_lineage(used.groupBy("image_id", *RGB).agg(F.sum("n").alias("n")))
    report = histogram.color_report(palette, used)
    views = None
    if textures is not None:
        views = mapping.nearest_entries(textures, palette, "image_id")
        views = textures.join(mapping.by_color(views), ["image_id", *RGB]).select("image_id", "texture_no", "x", "y", "idx", "a")
        if grey_post and textures_post:
            keyed = views.withColumn("one", F.concat_ws("/", "image_id", "texture_no"))
            smooth = neighborhood.smooth_dither(keyed.select(F.col("one").alias("image_id"), "x", "y", "idx"), size, grey_post).withColumnRenamed("image_id", "one")
            views = smooth.join(keyed.drop("idx"), ["one", "x", "y"]).drop("one")
        views = mapping.clear_transparent_index(views)
    levels = size
    if upscale_sigma is not None and size < 256:
        keyed = rows.withColumn("row_key", F.struct("palette_id", "row_no"))
        wide = lut.upscale_lut(keyed, 256, upscale_sigma, "row_key")
        rows = wide.select("row_key.palette_id", "row_key.row_no", "idx", *RGB)
        stretched = F.least(F.bround(F.col("idx") * 255.0 / max(size - 1, 1)).cast("int"), F.lit(255))
        grey, levels = grey.withColumn("idx", stretched), 256
        views = views.withColumn("idx", stretched) if views is not None else None
    shown = {} if views is None else {"texture_images": views.withColumn("display", color.index_to_display(F.col("idx"), levels))}
    return {
        **shown,
        "palette": palette,
        "index_image": grey.withColumn("display", color.index_to_display(F.col("idx"), levels)),
        "texture": lut.compose_palette(rows, row_height, "gradient"),
        "report": report,
    }


def generate_palettes(
    px: DataFrame,
    size: int = PALETTE_SIZE,
    single: bool = True,
    method: str = "libimagequant",
    quant_size: int | None = None,
    post: str | None = "median",
    exact: bool = False,
) -> dict[str, DataFrame]:
    """A folder of images to one shared palette (``single``) or one palette each, and their index images.

    Images are quantized first, then the palettes' distinct colours are merged: by Lab cells, or with ``exact`` by the order-exact clustering, which walks the
    colours of a palette's owner one by one in one task.
    """
    q = quantize.quantize(px, method, quant_size or size, post)
    scope = "scope" if single else "image_id"
    scoped = cluster.one_scope if single else (lambda df: df)
    colors = scoped(q["palette"]).select(scope, *RGB).distinct().withColumn("n", F.lit(1))
    reduced = cluster.build_palette(colors, scope, size, exact=exact)
    source = scoped(q["hist"]).groupBy(scope, *RGB).agg(F.sum("n").alias("n"))
    padded = cut_lineage(lut.pad_palette(reduced["palette"], size, scope, source, reduced["pad_candidates"]))
    palette, _ = _in_order(padded, scope)
    place = palette.groupBy(scope, *RGB).agg(F.max("idx").alias("to_idx")).withColumnsRenamed({c: f"rep_{c}" for c in RGB})
    route = scoped(q["palette"]).join(reduced["color_map"], [scope, *RGB]).join(place, [scope, "rep_r", "rep_g", "rep_b"])
    keys = ["image_id", "idx"]
    index = q["index_image"].join(route.select(*keys, "to_idx"), keys).select("image_id", "x", "y", F.col("to_idx").alias("idx"))
    return {"palette": palette, "index_image": index}


def merge_groups(index_images: DataFrame, group_palettes: DataFrame, size: int, exact: bool = False) -> dict[str, DataFrame]:
    """Unify the palettes of several groups and re-index their images.

    Colours weigh by how often the groups' images use them and in how many images; palette colours no image uses still
    count once. ``index_images``: group_id, image_id, x, y, idx; ``group_palettes``: group_id, idx, r, g, b.
    """
    uses = index_images.groupBy("group_id", "image_id", "idx").agg(F.count(F.lit(1)).alias("n"))
    colored = uses.join(group_palettes, ["group_id", "idx"])
    per_image = colored.groupBy("group_id", "image_id", *RGB).agg(F.sum("n").alias("n"))
    seen = per_image.select(*RGB, "n", F.lit(1).alias("cov"))
    every = group_palettes.select(*RGB).distinct().select(*RGB, F.lit(0).cast("long").alias("n"), F.lit(0).alias("cov"))
    hist = seen.unionByName(every).groupBy(*RGB).agg(F.sum("n").alias("n"), F.sum("cov").alias("coverage"))
    hist = cluster.one_scope(hist.select(*RGB, F.greatest("n", F.lit(1)).alias("n"), "coverage"))
    reduced = cluster.reduce_palette(hist, "scope", size, exact)
    padded = cut_lineage(lut.pad_palette(reduced["palette"], size, "scope", None, reduced["pad_candidates"]))
    palette, _ = _in_order(padded, "scope")
    index = mapping.group_index_remap(index_images, group_palettes, reduced["color_map"].drop("scope"), palette)
    return {"palette": palette, "index_image": index}


def add_palette_rows(
    texture: DataFrame, pairs: DataFrame, px: DataFrame, row_height: int = ROW_HEIGHT, method: str | None = None, size: int = PALETTE_SIZE
) -> DataFrame:
    """Append one palette row per (grey, colour) pair to existing palette textures.

    ``texture``: palette_id, x, y, r, g, b; ``pairs``: palette_id, pair_no, grey_id, color_id (image ids of ``px``).
    Grey images index by their red channel. With ``method`` the colour images are quantized to ``size`` colours first.
    """
    old = lut.extract_rows(texture, row_height)
    w = Window.partitionBy("palette_id").orderBy("row_no")
    old = old.withColumn("row_no", F.dense_rank().over(w) - 1)
    extent = old.groupBy("palette_id").agg((F.max("row_no") + 1).alias("rows"), (F.max("idx") + 1).alias("width"))
    if method:
        q = quantize.quantize(px, method, size, None)
        flat = q["index_image"].join(q["palette"], ["image_id", "idx"])
    else:
        flat = px
    key = F.struct("palette_id", "pair_no").alias("row_key")
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    of = lambda side: sizes.select(F.col("image_id").alias(f"{side}_id"), F.col("w").alias(f"{side}_w"), F.col("h").alias(f"{side}_h"))
    greys = px.select(F.col("image_id").alias("grey_id"), "x", "y", F.col("r").alias("level"))
    colors = flat.select(F.col("image_id").alias("color_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), *RGB)
    asked = pairs.join(extent, "palette_id").join(of("grey"), "grey_id").join(of("color"), "color_id").join(greys, "grey_id")
    # another size: the pixel at the same relative place
    place = lambda v, c, g: F.floor((F.col(v) + 0.5) * F.col(c) / F.col(g)).cast("int")
    asked = asked.withColumns({"cx": place("x", "color_w", "grey_w"), "cy": place("y", "color_h", "grey_h")})
    indexed = asked.join(colors, ["color_id", "cx", "cy"]).select(key, F.least(F.col("level"), F.col("width") - 1).alias("idx"), *RGB)
    base = pairs.select("palette_id", key).join(old.where("row_no = 0"), "palette_id").select("row_key", "idx", *RGB)
    built = lut.build_row(indexed, base, "row_key").select("row_key.palette_id", "row_key.pair_no", "idx", *RGB)
    order = F.row_number().over(Window.partitionBy("palette_id").orderBy("pair_no")) - 1
    placed = pairs.select("palette_id", "pair_no", order.alias("place")).join(extent, "palette_id")
    new = built.join(placed, ["palette_id", "pair_no"]).select("palette_id", (F.col("rows") + F.col("place")).cast("int").alias("row_no"), "idx", *RGB)
    return lut.compose_palette(old.select("palette_id", "row_no", "idx", *RGB).unionByName(new), row_height)
