"""Fixed-budget string records of plugin files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.functions import paths, tokens


def rename_strings(records: DataFrame, terms: Column, new_name: str) -> DataFrame:
    """Replace the terms, in order, in every EDID text; accepted only when the result fits its byte budget.

    Adds ``new_text``, ``changed`` and the NUL-padded ``payload`` of changed records.
    """
    new = F.lit(os.path.splitext(new_name)[0])  # a name of dots and an extension only is all name
    tried = tokens.replace_terms(F.col("text"), terms, new)
    out = records.where(F.col("tag") == "EDID").withColumn("_t", tried)
    changed = tokens.fits_and_changes(F.col("text"), F.col("_t"), F.col("size"))
    out = out.withColumns({"changed": changed, "new_text": F.when(changed, F.col("_t")).otherwise(F.col("text"))}).drop("_t")
    return out.withColumn("payload", F.when(F.col("changed"), tokens.nul_padded(F.col("new_text"), F.col("size"))))


def default_terms(path: Column) -> Column:
    """With no terms given, the file's own stem is looked for."""
    return F.array(paths.stem(path))


def set_header(headers: DataFrame, tag: str, value: str) -> DataFrame:
    """First header record of ``tag`` per file that fits ``value`` and differs from it, with its new payload.

    ``headers``: path, rec_offset, tag, size, text - the candidates of the first 20 000 bytes.
    """
    new = F.lit(value)
    fits = headers.where((F.col("tag") == tag) & tokens.fits_and_changes(F.col("text"), new, F.col("size")))
    first = fits.groupBy("path").agg(F.min(F.struct("rec_offset", "size", "text")).alias("h"))
    picked = first.select("path", "h.rec_offset", F.lit(tag).alias("tag"), "h.size", "h.text")
    return picked.withColumns({"new_text": new, "payload": tokens.nul_padded(new, F.col("size"))})


def renamed_counts(renamed: DataFrame) -> DataFrame:
    return renamed.groupBy("path").agg(F.count_if("changed").alias("changed"), F.count(F.lit(1)).alias("records"))
