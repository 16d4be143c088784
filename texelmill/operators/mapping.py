"""Nearest-palette mapping, representative assignment and lookup tables.

A palette never exceeds 256 entries, so it travels as ONE row holding an array (``packed_palette``). Searches run inside
that array per row; no pair of (pixel, entry) ever becomes a row and no cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.functions import color

RGB = ["r", "g", "b"]
MAX_PALETTE = 256
CELL_BITS = 4  # RGB cells of edge 16: 4096 cells
CELL_EDGE = 1 << CELL_BITS
_DE_UNITS = 10**9  # colour differences are compared in steps of 1e-9
_DE_SPAN = 1 << 40  # more than the largest difference in those steps


def packed_palette(palette: DataFrame, by: str = "palette_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per palette with ``entries`` sorted by idx; fails loudly beyond 256 entries."""
    rows = F.array_sort(F.collect_list(F.struct("idx", *RGB, *extra)))
    size_error = F.raise_error(F.concat(F.lit("palette larger than 256 entries: "), F.col(by).cast("string")))
    return (
        palette.groupBy(by)
        .agg(rows.alias("entries"))
        .withColumn("entries", F.when(F.size("entries") <= MAX_PALETTE, F.col("entries")).otherwise(size_error))
    )


def nearest_index(r: Column, g: Column, b: Column, entries: Column, exact_last: bool = False) -> Column:
    """Index of the entry with the smallest squared RGB distance; ties go to the lowest index.

    With ``exact_last`` an exact colour match that occurs several times goes to its highest index, as a lookup built
    by overwriting duplicates does.
    """

    def score(p: Column) -> Column:
        d = (p["r"] - r) * (p["r"] - r) + (p["g"] - g) * (p["g"] - g) + (p["b"] - b) * (p["b"] - b)
        tie = F.when(d == 0, F.lit(1023) - p["idx"]).otherwise(p["idx"]) if exact_last else p["idx"]
        return d * 1024 + tie

    best = F.array_min(F.transform(entries, score))
    if not exact_last:
        return best % 1024
    return F.when(best < 1024, F.lit(1023) - best).otherwise(best % 1024)


def _cell(r: Column, g: Column, b: Column) -> Column:
    side = 8 - CELL_BITS
    part = lambda c: F.shiftright(c, CELL_BITS)
    return F.shiftleft(part(r), 2 * side).bitwiseOR(F.shiftleft(part(g), side)).bitwiseOR(part(b))


def candidate_cells(packed: DataFrame, by: str = "palette_id") -> DataFrame:
    """Per palette and RGB cell (4096 of them) the entries that can be nearest to some colour of the cell.

    An entry stays when its smallest distance to the cell is no more than the smallest, over entries, of the largest
    distance to the cell. That keeps every possible winner, so the later search is exact.
    """
    side = 8 - CELL_BITS
    mask = (1 << side) - 1
    cells = packed.select(by, "entries", F.explode(F.sequence(F.lit(0), F.lit((1 << (3 * side)) - 1))).alias("cell"))
    low = {
        "r": F.shiftright("cell", 2 * side).bitwiseAND(mask) * CELL_EDGE,
        "g": F.shiftright("cell", side).bitwiseAND(mask) * CELL_EDGE,
        "b": F.col("cell").bitwiseAND(mask) * CELL_EDGE,
    }
    cells = cells.withColumns({f"_{c}": v for c, v in low.items()})
    top = CELL_EDGE - 1

    def square(c: Column) -> Column:
        return c * c

    def far(p: Column) -> Column:
        return sum(
            (square(F.greatest(F.abs(p[c] - F.col(f"_{c}")), F.abs(p[c] - F.col(f"_{c}") - top))) for c in RGB), F.lit(0)
        )

    def near(p: Column) -> Column:
        return sum(
            (square(F.greatest(F.col(f"_{c}") - p[c], p[c] - F.col(f"_{c}") - top, F.lit(0))) for c in RGB), F.lit(0)
        )

    kept = color.let(F.array_min(F.transform("entries", far)), lambda bound: F.filter("entries", lambda p: near(p) <= bound))
    return cells.select(by, "cell", kept.alias("entries"))


def map_to_shared_palette(px: DataFrame, palette: DataFrame, out: str = "idx", exact_last: bool = False) -> DataFrame:
    """Nearest entry of ONE palette (``idx, r, g, b``, at most 256 entries) for every pixel.

    The candidate table has 4096 rows of at most 256 entries (50 MB at the very worst, usually well below one) and is
    broadcast, so the pixel table is neither shuffled nor joined with itself.
    """
    one = packed_palette(palette.select(F.lit(0).alias("palette_id"), "idx", *RGB))
    cells = F.broadcast(candidate_cells(one).select("cell", F.col("entries").alias("_entries")))
    at = _cell(F.col("r"), F.col("g"), F.col("b"))
    joined = px.withColumn("cell", at).join(cells, "cell", "left")
    idx = nearest_index(F.col("r"), F.col("g"), F.col("b"), F.col("_entries"), exact_last)
    return joined.withColumn(out, idx).drop("cell", "_entries")


def by_color(table: DataFrame) -> DataFrame:
    """A table with a row per image and colour, to be joined by these: shuffled, never broadcast.

    It grows with the pixels, but its file is a few bytes a row, so a size threshold takes millions of rows for a small table and builds them on the driver.
    """
    return table.hint("merge")


def nearest_entries(colors: DataFrame, palette: DataFrame, by: str, out: str = "idx", keep: tuple[str, ...] = ()) -> DataFrame:
    """Nearest entry of each distinct (``by``, r, g, b) in its own palette, ties to the lowest index. ``keep``: further columns of ``colors``, which then has each colour once.

    The packed palette unfolds next to each colour inside one generated stage and a running minimum - one LONG of
    (distance, idx) - folds it again at once; ``colors`` is already placed by its key, so nothing more is shuffled.
    """
    packed = packed_palette(palette, by).withColumnRenamed("entries", "_entries")
    near = colors.select(by, *RGB, *keep).join(packed, by, "left").select(by, *RGB, *keep, F.explode_outer("_entries").alias("p"))
    d = sum(((F.col(f"p.{c}") - F.col(c)) * (F.col(f"p.{c}") - F.col(c)) for c in RGB), F.lit(0))
    best = near.groupBy(by, *RGB).agg(F.min(d * 1024 + F.col("p.idx")).alias("_s"), *[F.max(c).alias(c) for c in keep])
    return best.select(by, *RGB, *keep, (F.col("_s") % 1024).alias(out))


def map_to_palette(px: DataFrame, palette: DataFrame, by: str = "palette_id", exact: DataFrame | None = None, out: str = "idx") -> DataFrame:
    """Nearest entry of each pixel's own palette (``by`` names the palette in both frames).

    ``exact`` (``by``, r, g, b, exact_idx) overrides the search for the colours it lists. The search runs once per
    distinct (palette, colour); a join on that key brings the answer back and AQE splits it when one colour is hot.
    """
    mapped = nearest_entries(px.select(by, *RGB).distinct(), palette, by, out)
    if exact is not None:
        mapped = mapped.join(exact, [by, *RGB], "left").select(by, *RGB, F.coalesce("exact_idx", out).alias(out))
    return px.join(mapped, [by, *RGB], "left")


def apply_color_map(px: DataFrame, color_map: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Replace colours by ``rep_r, rep_g, rep_b``; colours without an entry stay as they are."""
    joined = px.join(color_map.select(*keys, *RGB, "rep_r", "rep_g", "rep_b"), [*keys, *RGB], "left")
    return joined.withColumns({c: F.coalesce(f"rep_{c}", c) for c in RGB}).drop("rep_r", "rep_g", "rep_b")


def assign_representatives(colors: DataFrame, reps: DataFrame, scope: str, same_bin_first: bool = True) -> DataFrame:
    """Closest representative (CIEDE2000) per colour, preferring those in the colour's hue bin, then the lowest idx.

    ``colors``: scope, r, g, b, lab_l, lab_a, lab_b, hue_bin; ``reps``: scope, idx, r, g, b, lab_*, hue_bin (at most
    256 per scope). The packed reps unfold next to each colour inside one generated stage, and the running minimum - one
    LONG of (other bin, distance, idx) - folds them before anything is shuffled.
    """
    packed = packed_palette(reps, scope, ("lab_l", "lab_a", "lab_b", "hue_bin")).withColumnRenamed("entries", "_reps")
    key = color.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("_rgb")
    near = colors.select(scope, key, "lab_l", "lab_a", "lab_b", "hue_bin").join(packed, scope)
    near = near.select(scope, "_rgb", "lab_l", "lab_a", "lab_b", "hue_bin", F.explode("_reps").alias("p"))
    near = near.select("*", *[F.col(f"p.lab_{c}").alias(f"p_{c}") for c in "lab"])
    near = color.with_delta_e2000(near, ("p_l", "p_a", "p_b"), ("lab_l", "lab_a", "lab_b"), "_de")
    other = (F.col("p.hue_bin") != F.col("hue_bin")).cast("bigint") if same_bin_first else F.lit(0).cast("bigint")
    score = (other * _DE_SPAN + F.round(F.col("_de") * _DE_UNITS).cast("bigint")) * MAX_PALETTE + F.col("p.idx")
    best = near.groupBy(scope, "_rgb").agg(F.min(score).alias("_s"))
    best = best.select(scope, "_rgb", F.pmod("_s", F.lit(MAX_PALETTE)).cast("int").alias("rep_idx"), F.floor(F.col("_s") / MAX_PALETTE).alias("_d"))
    named = reps.select(scope, F.col("idx").alias("rep_idx"), *[F.col(c).alias(f"rep_{c}") for c in RGB])
    return best.join(named, [scope, "rep_idx"]).select(
        scope,
        *[v.alias(c) for c, v in color.unpack_rgb(F.col("_rgb")).items()],
        *[f"rep_{c}" for c in RGB],
        "rep_idx",
        (F.pmod("_d", F.lit(_DE_SPAN)) / _DE_UNITS).alias("delta_e"),
    )


def lut256(palette: DataFrame, by: str = "palette_id") -> DataFrame:
    """One 256-entry lookup per palette row: the row itself, or its linear interpolation (truncated) when not 256 wide."""
    packed = packed_palette(palette, by)
    n = F.size("entries")
    pos = lambda i: i * (n - 1) / F.lit(255.0)

    def blend(i: Column) -> Column:
        lo = F.floor(pos(i)).cast("int")
        hi = F.least(lo + 1, n - 1)
        part = pos(i) - lo
        at = lambda k, c: F.element_at("entries", k + 1)[c]
        return F.struct(
            i.alias("idx"),
            *[F.floor(F.round(at(lo, c) + (at(hi, c) - at(lo, c)) * part, 9)).cast("int").alias(c) for c in RGB],
        )

    lut = F.when(n == MAX_PALETTE, F.col("entries")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(255)), blend))
    return packed.select(by, lut.alias("lut"))


def apply_lut(index_image: DataFrame, palette: DataFrame, by: str = "palette_id") -> DataFrame:
    """Colour an index image through its palette row; alpha is kept."""
    joined = index_image.join(lut256(palette, by), by)
    hit = F.element_at("lut", F.col("idx") + 1)
    return joined.withColumn("_c", hit).select("image_id", "x", "y", *[F.col(f"_c.{c}").alias(c) for c in RGB], "a")


def palette_row_at(texture: DataFrame, y: int) -> DataFrame:
    """The palette row at scan-line ``y`` of each palette texture, clamped to the texture."""
    height = texture.groupBy("palette_id").agg((F.max("y") + 1).alias("_h"))
    line = F.greatest(F.lit(0), F.least(F.col("_h") - 1, F.lit(y)))
    return texture.join(height, "palette_id").where(F.col("y") == line).select("palette_id", F.col("x").alias("idx"), *RGB)


def mask_alpha(px: DataFrame, mask: DataFrame, index_col: str | None = None) -> DataFrame:
    """Keep alpha inside the mask (image_id, x, y), zero it outside; optionally zero the index of clear pixels."""
    inside = mask.select("image_id", "x", "y", F.lit(1).alias("_in"))
    out = px.join(inside, ["image_id", "x", "y"], "left").withColumn("a", F.when(F.col("_in") == 1, F.col("a")).otherwise(0))
    if index_col:
        out = out.withColumn(index_col, F.when(F.col("a") == 0, 0).otherwise(F.col(index_col)))
    return out.drop("_in")


def clear_transparent_index(index_image: DataFrame, index_col: str = "idx") -> DataFrame:
    """Fully transparent pixels take index 0."""
    return index_image.withColumn(index_col, F.when(F.col("a") == 0, 0).otherwise(F.col(index_col)))


def convert_to_palette(px: DataFrame, palette: DataFrame, by: str = "palette_id") -> DataFrame:
    """Nearest palette entry per pixel, its colour and a display grey scaled by the image's highest used index."""
    mapped = map_to_palette(px, palette, by).withColumnsRenamed({c: f"src_{c}" for c in RGB})
    top = mapped.groupBy("image_id").agg(F.max("idx").alias("_top"))
    shown = F.floor(F.col("idx") * 255 / F.greatest(F.col("_top"), F.lit(1))).cast("int")
    colored = mapped.join(palette.select(by, "idx", *RGB), [by, "idx"]).join(top, "image_id")
    return colored.select("image_id", "x", "y", "idx", *RGB, shown.alias("display"))


def group_index_remap(index_image: DataFrame, group_palette: DataFrame, color_map: DataFrame, unified: DataFrame) -> DataFrame:
    """Group index -> group colour -> representative -> unified index; unmapped colours go to the nearest RGB.

    ``index_image``: group_id, image_id, x, y, idx; ``group_palette``: group_id, idx, r, g, b; ``color_map``: r, g, b,
    rep_*; ``unified``: idx, r, g, b. Indices beyond the group palette are clipped to its last entry.
    """
    mapped = apply_color_map(group_palette, color_map)
    lookup = map_to_shared_palette(mapped.withColumnRenamed("idx", "group_idx"), unified, "unified_idx", exact_last=True)
    lookup = lookup.select("group_id", "group_idx", "unified_idx")
    last = group_palette.groupBy("group_id").agg(F.max("idx").alias("_last"))
    clipped = index_image.join(last, "group_id").withColumn("group_idx", F.least("idx", "_last"))
    return clipped.join(lookup, ["group_id", "group_idx"]).select("group_id", "image_id", "x", "y", "unified_idx")
