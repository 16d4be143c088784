"""Text inputs: six-column list files and UV triangle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texelmill.functions import paths

COLUMNS = ("role", "perspective", "actor_kw", "target_kw", "behavior", "anim_paths")


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Windows-1252 (bytes that code page leaves undefined are dropped)."""
    high = bytes(range(0x80, 0xA0))
    known = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in high]
    source = "".join(c for c, t in known if t) + "".join(c for c, t in known if not t)
    target = "".join(t for _, t in known)
    fallback = F.translate(F.decode(content, "ISO-8859-1"), source, target)
    return F.coalesce(F.try_validate_utf8(content.cast("string")), fallback)


def split_lines(files: DataFrame) -> DataFrame:
    """``path, content`` to ``path, line_no, value``; line 0 is the header."""
    text = F.regexp_replace(decode_text(F.col("content")), "\r\n", "\n")
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    return files.select("path", F.posexplode(lines).alias("line_no", "value"))


def parse_subgraph(lines: DataFrame) -> DataFrame:
    """Tab-separated ``value`` to the six columns and ``rest``; blank lines and lines with fewer fields are left out."""
    cols = F.split("value", "\t", -1)
    full = lines.where((F.trim("value") != "") & (F.size(cols) >= len(COLUMNS)))
    keep = [c for c in lines.columns if c != "value"]
    rest = F.slice(cols, len(COLUMNS) + 1, F.greatest(F.size(cols) - len(COLUMNS), F.lit(0)))
    return full.select(*keep, *[cols[i].alias(c) for i, c in enumerate(COLUMNS)], rest.alias("rest"))


def read_subgraph(spark: SparkSession, path: str) -> DataFrame:
    """List files with their encoding settled per file; these files are small, their number may be large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = parse_subgraph(split_lines(files)).where(F.col("line_no") > 0)
    return rows.withColumn("file_stem", paths.stem(F.col("path")))


def subgraph_lines(rows: DataFrame) -> DataFrame:
    """Rows back to tab-separated text."""
    rest = F.when(F.size("rest") > 0, F.array_join("rest", "\t"))
    return rows.withColumn("value", F.concat_ws("\t", *COLUMNS, rest))


def read_uv_triangles(records: DataFrame) -> DataFrame:
    """``{"uvs": [[u, v]], "tris": [[i, j, k]]}`` in ``value`` to one row per triangle with its three UV pairs."""
    parsed = records.withColumn("_j", F.from_json("value", "uvs array<array<double>>, tris array<array<int>>"))
    keep = [c for c in records.columns if c != "value"]
    rows = parsed.select(*keep, F.col("_j.uvs").alias("_uvs"), F.posexplode("_j.tris").alias("tri_id", "_t"))
    corner = lambda k: F.element_at("_uvs", F.col("_t")[k] + 1)
    return rows.select(*keep, "tri_id", *[corner(k)[j].alias(f"{c}{k}") for k in range(3) for j, c in enumerate("uv")])
