"""File listings, texture headers and the table sinks of the asset domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texelmill.functions import paths
from texelmill.operators.pathops import archive_entries, manifest_lines, scan_filter
from texelmill.operators.resize import BC7_UNORM, BC7_UNORM_SRGB
from texelmill.sources.files import read_prefixes

# fixed values of the texture header: magic, extended FourCC, byte positions (1-based) and least sizes
DDS_MAGIC_HEX, DX10_HEX = "44445320", "44583130"
HEIGHT_AT, WIDTH_AT, FOURCC_AT, DXGI_AT = 13, 17, 85, 129
HEADER_BYTES, EXTENDED_HEADER_BYTES = 128, 148


def binary_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root)


def scan_assets(spark: SparkSession, root: str, recursive: bool = True, extensions: Sequence[str] = paths.IMAGE_EXTENSIONS) -> DataFrame:
    """``path, length, modificationTime`` of image files; contents are never read."""
    files = binary_files(spark, root, recursive).select("path", "length", "modificationTime")
    return scan_filter(files, extensions).orderBy("path")


def scan_materials(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    files = binary_files(spark, root, recursive).select("path", "length", "modificationTime")
    return scan_filter(files, paths.MATERIAL_EXTENSIONS).orderBy("path")


def little_endian(content: Column, at: int, size: int = 4) -> Column:
    """Unsigned little-endian integer at a 1-based byte position."""
    digits = F.hex(F.substring(content, at, size))
    swapped = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def texture_headers(files: DataFrame) -> DataFrame:
    """Width, height, DXGI code and BC7 flags from ``path, content``; null without magic or with a short header."""
    content = F.col("content")
    good = (F.length(content) >= HEADER_BYTES) & (F.hex(F.substring(content, 1, 4)) == DDS_MAGIC_HEX)
    dx10 = good & (F.hex(F.substring(content, FOURCC_AT, 4)) == DX10_HEX)
    dxgi = F.when(dx10 & (F.length(content) >= EXTENDED_HEADER_BYTES), little_endian(content, DXGI_AT))
    out = files.select(
        "path",
        F.when(good, little_endian(content, WIDTH_AT)).cast("int").alias("width"),
        F.when(good, little_endian(content, HEIGHT_AT)).cast("int").alias("height"),
        F.when(good, dx10).alias("is_dx10"),
        dxgi.cast("int").alias("dxgi"),
    )
    bc7 = F.coalesce(F.col("dxgi").isin(BC7_UNORM, BC7_UNORM_SRGB), F.lit(False))
    linear = F.coalesce(F.col("dxgi") == BC7_UNORM, F.lit(False))
    return out.withColumns({"is_bc7": bc7, "is_bc7_linear": linear})


def scan_texture_headers(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """:func:`texture_headers` of the texture files below a folder; of each file only the header's bytes are read."""
    return texture_headers(read_prefixes(spark, root, EXTENDED_HEADER_BYTES, recursive, (".dds",)))


def write_manifest(files: DataFrame, root: str, target: str) -> None:
    """Write the manifest as ordered text parts; the parts one after another are the file. No files: ``[`` and ``]``."""
    entries = archive_entries(files, root)
    body = manifest_lines(entries).select(F.lit(1).alias("part"), "entry", "line")
    frame = files.sparkSession.createDataFrame([(0, "", "["), (2, "", "]")], "part int, entry string, line string")
    frame.unionByName(body).orderBy("part", "entry").select("line").write.mode("overwrite").text(target)


def output_names(files: DataFrame, group_name: str = "") -> DataFrame:
    """Names of the grey, colour and palette outputs of an image."""
    base = paths.stem(F.col("path"))
    if group_name:
        base = F.concat(base, F.lit("_"), paths.sanitize_name(F.lit(group_name)))
    return files.select("path", *[F.concat(base, F.lit("_" + k)).alias(f"{k}_name") for k in ("greyscale", "quant", "palette")])


def write_index_image(index_image: DataFrame, target: str) -> None:
    """Index images clustered by image and line inside each file, so later reads prune on ``image_id``."""
    ranged = index_image.repartitionByRange("image_id", "y")
    ranged.sortWithinPartitions("image_id", "y", "x").write.mode("overwrite").parquet(target)


def write_palette_texture(texture: DataFrame, target: str) -> None:
    texture.repartitionByRange("palette_id").sortWithinPartitions("palette_id", "y", "x").write.mode("overwrite").parquet(target)
