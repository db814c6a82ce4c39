"""Texts in, masked texts, vaults and reports out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Engine, engine, redact, vault_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row a line: file, text."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: file, text. For texts whose findings span lines."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def blocks(lines: DataFrame, size: int = 2000) -> DataFrame:
    """Blocks of lines out of rows (file, split, text) in reading order: file, split, block, text.

    Findings may span lines of a block; one across two blocks can be torn. A block ends after
    ``size`` lines and where its file or split ends, so a task holds one block at a time, nothing
    is shuffled, and it works on streams. Null lines count as empty ones; no line gives no block.
    """
    if size < 1:
        raise ValueError("a block has one line at least")

    def cut(batches):
        held, place, number = [], None, 0

        def made():
            return pd.DataFrame({"file": [place[0]], "split": [place[1]], "block": [number], "text": ["\n".join(held)]})

        for batch in batches:
            for file, split, text in zip(batch["file"], batch["split"], batch["text"]):
                if held and (place != (file, split) or len(held) == size):
                    yield made()
                    number, held = number + 1, []
                if place != (file, split):
                    place, number = (file, split), 0
                held.append(text or "")
        if held:
            yield made()

    return lines.select("file", "split", "text").mapInPandas(cut, "file string, split bigint, block bigint, text string")


def read_blocks(spark: SparkSession, paths: str | list[str], size: int = 2000) -> DataFrame:
    """Blocks of up to ``size`` lines of text files; files that can't be read are left out."""
    lines = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths)
    return blocks(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text")), size)


def _split_paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths or patterns that something stands at, and those that nothing does."""
    there, gone = [], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        (there if p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) else gone).append(path)
    return there, gone


def _spelled(file: str) -> Column:
    """A file's URI with three slashes after ``file:``; metadata and listings differ in that."""
    return F.regexp_replace(file, "^file:/+", "file:///").alias("file")


def redact_files(spark: SparkSession, paths: str | list[str], out: str, eng: Engine | None = None, block_lines: int = 2000, form: str = "parquet") -> DataFrame:
    """Mask text files into a folder, in one job; returns findings by file, -1 where a file can't be read.

    Files are masked by blocks of lines. With ``form`` "text" each file becomes a folder
    ``file=<name>`` of text parts in the order of the file; "parquet" keeps rows (file, split,
    block, masked_text, n). Files are URIs. An empty file has 0. A path with no file is a row of its own.
    """
    there, gone = _split_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    missing = spark.createDataFrame([(p, -1) for p in gone], "file string, findings bigint")
    if not there:
        return missing
    # Scans skip empty files, so the names come from the listing, which Spark's driver holds anyway.
    names = spark.createDataFrame([(f,) for f in spark.read.text(there).inputFiles()], "file string").select(_spelled("file"))
    filled = spark.read.format("binaryFile").load(there).select(_spelled("_metadata.file_path"), F.lit(-1).alias("unread"))
    files = names.join(filled, "file", "left")
    done = redact(read_blocks(spark, there, block_lines), eng=eng or engine())
    rows = done.select("file", "split", "block", "masked_text", F.size("findings").alias("n"))
    table = f"{out}/_rows" if form == "text" else out
    rows.write.parquet(table)
    rows = spark.read.parquet(table)
    if form == "text":
        named = rows.withColumn("file", F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B"))))
        named.repartitionByRange("file", "split", "block").sortWithinPartitions("file", "split", "block").select("file", "masked_text").write.mode("append").partitionBy("file").text(out)
    counted = files.join(rows.groupBy(_spelled("file")).agg(F.sum("n").alias("n")), "file", "left")
    return counted.select("file", F.coalesce("n", "unread", F.lit(0)).cast("long").alias("findings")).unionByName(missing)


def write_vault(redacted: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> None:
    vault_rows(redacted, keys).write.parquet(path)


def restore_from(redacted: DataFrame, vault: DataFrame, key: str = "doc_id") -> DataFrame:
    """Masked texts with their originals put back from a vault table, joined by key."""
    maps = vault.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("replacement", "original"))).alias("__vault"))
    from ..plans.engine import restore

    joined = redacted.drop("vault").join(maps, key, "left").withColumn("__vault", F.coalesce("__vault", F.expr("cast(map() as map<string,string>)")))
    return restore(joined, vault_column="__vault").drop("__vault")
