"""Masking and counting on streams. Masking keeps no state; counts use event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Engine, engine, redact, scan
from ..sources.readers import blocks


def read_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of the text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumnRenamed("value", "text")


def read_blocks(spark: SparkSession, folder: str, size: int = 2000, max_files: int = 1000) -> DataFrame:
    """Blocks of up to ``size`` lines of the files that arrive in a folder, so findings may span lines."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return blocks(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text")), size)


def redact_stream(stream: DataFrame, text: str = "text", eng: Engine | None = None) -> DataFrame:
    """The stream with masked_text, findings and the rest of a redaction."""
    return redact(stream, text, eng or engine())


def write_masked(stream: DataFrame, out: str, checkpoint: str):
    """Start writing masked lines; the query's progress observes how many findings there were."""
    done = stream.select("masked_text", F.size("findings").alias("n"))
    seen = done.observe("masking", F.sum("n").alias("findings"), F.count(F.lit(1)).alias("texts"))
    return seen.select(F.col("masked_text").alias("value")).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, ts: str, text: str = "text", width: str = "5 minutes", late: str = "10 minutes", eng: Engine | None = None) -> DataFrame:
    """Findings by type and event-time window; rows later than ``late`` are left out."""
    found = scan(stream.withWatermark(ts, late), text, (ts,), eng or engine())
    return found.groupBy(F.window(ts, width), "type").agg(F.count(F.lit(1)).alias("n"))
