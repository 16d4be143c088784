"""UV triangles: grouping, rasterising to masks and masking textures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.functions import color, paths
from texelmill.operators.mapping import mask_alpha
from texelmill.operators.pathops import find_mesh, resolve_diffuse

CORNERS = ("0", "1", "2")


def uv_set_groups(shapes: DataFrame) -> DataFrame:
    """Shapes by (diffuse texture, uv-set number) with their sorted ids and a label.

    ``shapes``: mesh_path, shape_id, diffuse, uv_sets (array). Shapes without a diffuse texture or uv set are left out.
    """
    named = shapes.where(F.coalesce("diffuse", F.lit("")) != "")
    sets = named.select("mesh_path", "shape_id", "diffuse", F.posexplode("uv_sets").alias("uv_index", "_s"))
    out = sets.groupBy("mesh_path", "diffuse", "uv_index").agg(F.sort_array(F.collect_list("shape_id")).alias("shape_ids"))
    return out.withColumn("label", F.concat("diffuse", F.lit(" - UV "), F.col("uv_index").cast("string")))


def to_pixels(triangles: DataFrame, wrap: bool = True, quarter: bool = False) -> DataFrame:
    """Corner pixel coordinates ``x0..x2, y0..y2`` of UV triangles on their ``w`` x ``h`` texture."""
    out = triangles
    for k in CORNERS:
        u, v = F.col(f"u{k}"), F.col(f"v{k}")
        if quarter:
            u, v = color.expand_quarter_uv(u), color.expand_quarter_uv(v)
        at = color.uv_to_px(u, v, F.col("w"), F.col("h"), wrap)
        out = out.withColumns({f"x{k}": at["px"], f"y{k}": at["py"]})
    return out


def uv_mask(triangles: DataFrame, by: tuple[str, ...], wrap: bool = True, quarter: bool = False) -> DataFrame:
    """Covered pixels (``by``, x, y) of the union of triangles, edges included.

    ``triangles``: by, u0..u2, v0..v2, w, h. A triangle becomes one row per scan-line of its box, then only the pixels
    between the edges that cross that line; the edge test decides, so the result is exact. Distinct pixels are folded
    map-side before the shuffle.
    """
    t = to_pixels(triangles, wrap, quarter)
    xs, ys = ([F.col(f"{c}{k}") for k in CORNERS] for c in "xy")
    lines = F.sequence(F.ceil(F.least(*ys)).cast("int"), F.floor(F.greatest(*ys)).cast("int"))
    tall = t.where(F.ceil(F.least(*ys)) <= F.floor(F.greatest(*ys)))
    rows = tall.select(*by, *[f"{c}{k}" for k in CORNERS for c in "xy"], F.explode(lines).alias("y"))

    def crossing(a: int, b: int) -> tuple[Column, Column]:
        """Lowest and highest x of edge a-b on this line, null when the edge does not reach it."""
        y, ya, yb, xa, xb = F.col("y"), ys[a], ys[b], xs[a], xs[b]
        on = y.between(F.least(ya, yb), F.greatest(ya, yb))
        flat = ya == yb
        at = xa + (y - ya) * (xb - xa) / F.when(flat, 1.0).otherwise(yb - ya)
        return F.when(on, F.when(flat, F.least(xa, xb)).otherwise(at)), F.when(on, F.when(flat, F.greatest(xa, xb)).otherwise(at))

    spans = [crossing(0, 1), crossing(1, 2), crossing(2, 0)]
    left, right = F.least(*[s[0] for s in spans]), F.greatest(*[s[1] for s in spans])
    # one pixel of slack on both sides; the edge test below settles it
    lo = F.greatest(F.floor(left).cast("int") - 1, F.ceil(F.least(*xs)).cast("int"))
    hi = F.least(F.ceil(right).cast("int") + 1, F.floor(F.greatest(*xs)).cast("int"))
    spread = rows.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))
    cells = spread.withColumn("x", F.explode(F.sequence("_lo", "_hi")))

    def side(a: int, b: int) -> Column:
        return (xs[b] - xs[a]) * (F.col("y") - ys[a]) - (ys[b] - ys[a]) * (F.col("x") - xs[a])

    e = [side(0, 1), side(1, 2), side(2, 0)]
    inside = (F.least(*e) >= 0) | (F.greatest(*e) <= 0)
    return cells.where(inside).select(*by, "x", "y").distinct()


def remove_uv_padding(
    px: DataFrame, textures: DataFrame, meshes: DataFrame, shapes: DataFrame, materials: DataFrame, data_root: str, wrap: bool = True
) -> DataFrame:
    """Zero the alpha of everything outside the UV area of each ``_d`` texture's mesh.

    ``textures``: image_id, path, w, h; ``shapes``: mesh_path, shape_id, slot_path, triangle columns u0..v2 (one row per
    triangle). Shapes whose diffuse texture is the texture count; when none is, all shapes of the mesh do. Textures
    without mesh or triangles are left out, as skipped.
    """
    tex = textures.where(paths.is_diffuse_texture(F.col("path")))
    meshed = tex.join(find_mesh(tex, meshes, data_root), "path").where(F.col("mesh_path").isNotNull())
    named = resolve_diffuse(shapes, materials)
    tri = named.join(meshed.select("mesh_path", "image_id", "path", "w", "h"), "mesh_path")
    own = F.coalesce("slot_path", F.lit("")) != ""
    tri = tri.withColumn("_match", own & paths.texture_path_matches(F.col("diffuse"), F.col("path")))
    any_match = tri.groupBy("image_id").agg(F.max("_match").alias("_any"))
    used = tri.join(any_match, "image_id").where(F.col("_match") | ~F.col("_any"))
    mask = uv_mask(used, ("image_id",), wrap)
    known = used.select("image_id").distinct()
    return mask_alpha(px.join(known, "image_id", "left_semi"), mask)
