"""Incremental ingestion and running figures with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.extract import READERS


def watch_directory(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], checkpoint: str, suffixes: list[str] | None = None, archive: str | None = None) -> StreamingQuery:
    """Hands each new file once to ``handle`` (path, content, ...) and stops when none is left.

    ``archive`` moves what was read there.  The checkpoint makes a restart go on after the last
    finished batch.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    allowed = [s.lstrip(".") for s in (suffixes or [*READERS, ".pdf"])]
    files = reader.load(path).where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(allowed))
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_outcomes(events: DataFrame, time_col: str, outcome_col: str, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts by window and outcome of a stream (or a table), late rows within ``late`` included."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), outcome_col).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), outcome_col, "n")
