"""Incremental runs: the row-wise operators and run counters over arriving files.

Filters, names, headers, decoding and rewriting take streaming frames unchanged; only the counters keep state, one row of
sums per group, so the state never grows with the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from texelmill.functions import paths
from texelmill.operators.materials import run_summary
from texelmill.operators.pathops import scan_filter

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, root: str, extensions: Sequence[str] = paths.MATERIAL_EXTENSIONS, per_batch: int = 1000) -> DataFrame:
    """New files below ``root`` as they arrive."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    files = stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return scan_filter(files, extensions)


def running_summary(outcomes: DataFrame) -> DataFrame:
    """The counters of ``run_summary`` kept up to date over a streaming ``outcome`` column."""
    return run_summary(outcomes)


def write_summary(summary: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return (
        summary.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
