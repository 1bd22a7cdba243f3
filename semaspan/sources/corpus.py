"""Readers of line-oriented corpora and of folders with one file per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.session import stored
from semaspan.sources.group_files import group_of


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): one sentence per line."""
    return spark.read.text(path, lineSep="\n")


# One short row a split; so many are some tens of MB, and the splits of a hundred TB.
BROADCAST_SPLITS = 1_000_000


def numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of a file scan from 0 inside each file: adds file and line_no.

    Every split of a file is read front to back by one task, so a row's place in its split is its
    increasing id less the smallest one of that split. Only one row per split is summed up over the
    file and sent to all tasks; the lines themselves neither move nor are sorted. Number before any row is
    filtered.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_id", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(splits.select("file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    if starts.count() <= BROADCAST_SPLITS:  # counted; so the lines stay where they are read
        starts = F.broadcast(starts)
    return placed.join(starts, ["file", "_block"]).select(
        *rows.columns, "file", (F.col("_start") + F.col("_id") - F.col("_first")).alias("line_no")
    )


def read_numbered_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, line_no)."""
    return numbered(read_corpus(spark, path))


def read_groups(spark: SparkSession, folder: str, value: str = "sentence", pattern: str = "*.txt") -> DataFrame:
    """(construction, value): lines of all group files under a folder and the folders in it.

    The file name without `.txt` is the group; files `name~1.txt`, `name~2.txt` and so on hold more of `name`.
    Names are read as `group_files.write_group_files` writes them; a name that is no such code is taken as it is.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return lines.select(group_of(F.col("_metadata.file_name")).alias("construction"), F.col("value").alias(value))


def read_group_values(spark: SparkSession, folder: str, value: str = "score", pattern: str = "*.txt") -> DataFrame:
    """(construction, value) with one number per line."""
    lines = read_groups(spark, folder, "_text", pattern).filter(F.trim("_text") != "")
    return lines.select("construction", F.trim("_text").try_cast("double").alias(value))
