"""Writers. Folders take the place of single files, so that every task writes its own part."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_ROWS = 1_000_000  # rows of a group in one file, about
_INFER = "spark.sql.sources.partitionColumnTypeInference.enabled"


def write_table_once(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Delimited table with a header; an existing folder is left alone."""
    df.write.option("delimiter", delimiter).option("header", "true").mode("ignore").csv(path)


def write_text_once(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Lines of a single string column; an existing folder is left alone.

    A compressed file is read by one task, so it is as large as what one task writes.
    """
    df.write.mode("ignore").text(path, compression=compression)


def write_vector_space(vectors: DataFrame, path: str, nested: str = "ppmi", header: bool = True) -> None:
    """`lemma_pos|[[index, value], ...]`, replacing what is there."""
    lines = vectors.select("lemma_pos", F.col(nested).cast("string").alias(nested))
    lines.write.option("header", str(header).lower()).option("delimiter", "|").option("quote", "").mode("overwrite").csv(path)


def write_count_space(vectors: DataFrame, path: str) -> None:
    """`lemma_pos|[[index, count], ...]` in vocabulary order, from assembled vectors; written once."""
    cells = F.transform("vector", lambda p: F.array(p["basis_index"].cast("long"), p["n"].cast("long")))
    lines = vectors.orderBy("voc_index").select(F.concat_ws("|", "lemma_pos", cells.cast("string")).alias("value"))
    write_text_once(lines, path)


def write_freqs(ranked: DataFrame, path: str) -> None:
    """`rank|freq|lemma_pos` without a header, replacing what is there."""
    lines = ranked.orderBy("rank").select(F.concat_ws("|", "rank", "freq", "lemma_pos").alias("value"))
    lines.write.mode("overwrite").text(path)


def write_groups(groups: DataFrame, path: str, by: Sequence[str] = ("construction",), value: str = "sentence",
                 mode: str = "append") -> None:
    """One folder of text per group, in one file for each FILE_ROWS rows or so.

    Rows are placed by group and by a share of the group that follows from its counted size, so the number of
    files does not grow with the tasks, and a large group is written by many.
    """
    sizes = groups.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(FILE_ROWS)).cast("int").alias("_shares"))
    keyed = groups.select(*by, F.col(value).cast("string").alias("value"))
    match = reduce(Column.__and__, [keyed[c].eqNullSafe(sizes[c]) for c in by])
    sized = keyed.join(sizes, match).select(*[keyed[c] for c in by], "value", "_shares")
    share = F.pmod(F.xxhash64("value"), F.col("_shares"))
    sized.repartition(*by, share).select(*by, "value").write.mode(mode).partitionBy(*by).text(path)


def read_written_groups(spark, path: str, value: str = "sentence") -> DataFrame:
    """(group columns, value) back from `write_groups`; group keys come back as strings."""
    before = spark.conf.get(_INFER)
    spark.conf.set(_INFER, "false")  # else a key like 007 becomes a number
    try:
        return spark.read.text(path).withColumnRenamed("value", value)
    finally:
        spark.conf.set(_INFER, before)
