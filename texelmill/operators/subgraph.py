"""Six-column rows with list-valued columns: match, rewrite, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.functions import tokens


def _array(csv: str) -> Column:
    parts = [p.strip() for p in csv.split(",") if p.strip()]
    return F.array(*[F.lit(p) for p in parts]).cast("array<string>")


def match_rows(rows: DataFrame, target_anims: str, target_folders: str) -> DataFrame:
    """Rows with a wanted animation token and a folder whose last segment is wanted (exact, case-sensitive)."""
    folders = tokens.split_tokens(F.col("anim_paths"))
    has_anim = F.arrays_overlap(tokens.split_tokens(F.col("target_kw")), _array(target_anims))
    has_folder = F.exists(folders, lambda e: F.array_contains(_array(target_folders), tokens.last_segment(e)))
    return rows.where(F.coalesce(has_anim, F.lit(False)) & has_folder)


def rewrite_rows(rows: DataFrame, target_anims: str, new_anim: str, target_folders: str, new_folder: str, prepend: bool = True) -> DataFrame:
    """Matching rows with animation tokens replaced and folder entries replaced or preceded by the new folder."""
    matched = match_rows(rows, target_anims, target_folders)
    anims = tokens.replace_tokens(tokens.split_tokens(F.col("target_kw")), _array(target_anims), F.lit(new_anim.strip()))
    change = tokens.prepend_entries if prepend else tokens.replace_entries
    entries = change(tokens.split_tokens(F.col("anim_paths")), _array(target_folders), F.lit(new_folder.strip()))
    return matched.withColumns({"target_kw": tokens.join_tokens(anims), "anim_paths": tokens.join_tokens(entries)})


def output_name(file_stem: Column, new_folder: str, prepend: bool = True) -> Column:
    label = new_folder.strip().replace(",", "+").replace(" ", "") or "new"
    mode = "additive" if prepend else "replace"
    return F.concat(file_stem, F.lit(f"_{label}_{mode}.txt"))


def subgraph_summary(files: DataFrame, rewritten: DataFrame, new_folder: str, prepend: bool = True) -> DataFrame:
    """Per requested file: output name and matching rows, zero when the file is missing or nothing matches.

    ``files``: file_stem; ``rewritten``: file_stem and the rewritten rows.
    """
    counts = rewritten.groupBy("file_stem").agg(F.count(F.lit(1)).alias("n"))
    out = files.select("file_stem").distinct().join(counts, "file_stem", "left")
    return out.select("file_stem", output_name(F.col("file_stem"), new_folder, prepend).alias("out_name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
