"""Resize planning for texture sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelmill.functions import paths
from texelmill.operators.pathops import plan_product

# fixed values: DXGI codes of BC7 and its sRGB twin
BC7_UNORM, BC7_UNORM_SRGB = 98, 99


def resize_plan(
    headers: DataFrame,
    sizes: Sequence[int],
    out_root: str,
    src_root: str = "",
    method: str = "texconv",
    no_upscale: bool = True,
    convert_bc7: bool = False,
    per_size_folders: bool = True,
) -> DataFrame:
    """Action (copy, resize or convert), target size and output path for every texture and size.

    ``headers``: path, width, height, is_bc7. ``texconv`` copies what already fits and otherwise resizes to a square;
    the other methods keep the aspect ratio and never enlarge. With ``convert_bc7`` BC7 files are always re-encoded.
    """
    plan = plan_product(headers, sorted({s for s in sizes if s > 0}), "size")
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    longest = F.greatest(w, h)
    convert = F.lit(convert_bc7) & F.coalesce("is_bc7", F.lit(False))
    if method == "texconv":
        copy = F.lit(no_upscale) & (longest > 0) & (longest <= F.col("size")) & ~convert
        new_w, new_h = F.col("size"), F.col("size")
    else:
        scale = F.col("size") / F.when(longest > 0, longest)
        copy = F.lit(no_upscale) & F.coalesce(scale >= 1.0, F.lit(False)) & ~convert
        side = lambda n: F.when(scale < 1.0, F.greatest(F.lit(1), F.bround(n * scale).cast("int"))).otherwise(n)
        new_w, new_h = side(w), side(h)
    prefix = src_root.rstrip("/") + "/" if src_root else ""
    rel = F.when(F.col("path").startswith(prefix), F.substring("path", F.lit(len(prefix) + 1), F.length("path"))).otherwise(F.col("path"))
    size_dir = F.concat(F.col("size").cast("string"), F.lit("/")) if per_size_folders else F.lit("")
    return plan.select(
        "path",
        "size",
        F.when(copy, "copy").when(convert, "convert").otherwise("resize").alias("action"),
        F.when(copy, w).otherwise(new_w).alias("target_w"),
        F.when(copy, h).otherwise(new_h).alias("target_h"),
        F.concat(F.lit(out_root.rstrip("/") + "/"), size_dir, rel).alias("out_path"),
    )


def dds_files(files: DataFrame) -> DataFrame:
    return files.where(paths.extension(F.col("path")) == ".dds")
