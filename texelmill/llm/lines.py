"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate; one of each stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.session import cut_lineage

#: Standard error of a sketch of 2**k registers is 1.04 / sqrt(2**k).
LG_REGISTERS = 12
#: Half width of the band around the threshold, as a share of it, in which sites are counted exactly: over ten standard errors.
BAND = 0.2


def _own_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x))


def _key(line: Column) -> Column:
    """96 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def distinct_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(doc, site, a, b): each document's different lines once, by hash; blanks around a line don't count, empty lines are left out."""
    lines = docs.select(F.col(doc).alias("doc"), F.col(site).alias("site"), F.explode(F.array_distinct(_own_lines(F.col(text)))).alias("line"))
    return lines.where("line <> ''").select("doc", "site", _key(F.col("line")).alias("k")).select("doc", "site", "k.a", "k.b")


def wide_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(a, b, first): lines on at least ``min_sites`` sites and the smallest document that holds each.

    A HyperLogLog sketch of sites per line merges by aggregation. A line whose estimate is clear of the band around the threshold is decided
    by it; a line inside the band is decided by an exact distinct count.
    """
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sketch"), F.min("doc").alias("first"))
    spread = spread.select("a", "b", "first", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND))
    near = spread.where(F.col("sites") < min_sites * (1 + BAND))
    exact = lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.min("doc").alias("first"))
    exact = exact.groupBy("a", "b").agg(F.count("site").alias("sites"), F.min("first").alias("first")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") >= min_sites * (1 + BAND)).select("a", "b", "first").unionByName(exact.select("a", "b", "first"))


def remove_wide_lines(docs: DataFrame, min_sites: int = 10, doc: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """The same rows and columns, the text without boilerplate lines, plus ``n_lines`` and ``n_removed`` (long; an own column of that name is replaced).

    A line (blanks around it ignored, never an empty one) on ``min_sites`` or more different sites is removed from every document but the one with
    the smallest ``doc`` value among those that hold it, so no content leaves the corpus altogether. Other lines keep their exact bytes and
    order. A row without a site adds none; without a text it stays null with no lines; a row without ``doc`` is never the one that keeps a
    line unless all are. Rows with the same ``doc`` value count as one document. Hot lines are merged as sketches before the shuffle, and the join that finds who holds a
    wide line is a plain join that Spark may split.
    """
    lines = distinct_lines(docs, doc, text, site)
    wide = cut_lineage(wide_lines(lines, min_sites))  # a side of its own, so that the join's hot lines may be split
    held = lines.join(wide, ["a", "b"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    held = held.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("__wide"))
    held = held.withColumnRenamed("doc", "__doc")
    out = docs.join(held, F.col(doc).eqNullSafe(F.col("__doc")), "left").drop("__doc")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col("__wide").isNull(), parts).otherwise(F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__wide"), _key(F.trim(x)))))
    out = out.withColumn("__kept", kept).withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    out = out.withColumn("n_removed", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size("__kept")))
    return out.withColumn(text, F.array_join("__kept", "\n")).drop("__kept", "__wide")
