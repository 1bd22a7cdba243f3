"""Readers of the delimited tables: frequencies, vectors, scales, ratings, pairs, seed words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row[0] if row else ""


def _csv(spark: SparkSession, path: str, schema: str, sep: str, header: bool = False) -> DataFrame:
    # tokens may be quote characters, so quoting is off
    return spark.read.csv(
        path, schema=schema, sep=sep, header=header, quote="",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def read_freqs(spark: SparkSession, path: str) -> DataFrame:
    """(rank, freq, lemma_pos) from a list separated by "|", or by blanks if its first line has none.

    Three columns are rank, frequency and token; four are rank, lemma, tag and frequency.
    """
    first = _first_line(spark, path).strip()
    # blanks in front of a line are padding, so lines are trimmed before they are split
    mark = "|" if "|" in first else " "
    cells = F.split(F.trim("value"), re.escape(mark))
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.transform(cells, lambda c: F.trim(c)).alias("c"))
    c = [F.get("c", i) for i in range(4)]
    if len(first.split(mark)) == 3:
        freq, token = c[1], c[2]
    else:
        freq, token = c[3], F.concat_ws("_", c[1], c[2])
    return lines.select(c[0].try_cast("long").alias("rank"), freq.try_cast("long").alias("freq"), token.alias("lemma_pos"))


def read_vector_space(spark: SparkSession, path: str) -> DataFrame:
    """(lemma_pos, vector) from lines `lemma_pos|[[index, count], ...]`."""
    table = _csv(spark, path, "lemma_pos string, vector string", "|")
    return table.withColumn("vector", F.from_json("vector", T.ArrayType(T.ArrayType(T.LongType()))))


def read_ppmi_vector_space(spark: SparkSession, path: str) -> DataFrame:
    """(lemma_pos, ppmi) with a header; two columns by "|", or lemma, tag and vector by tabs."""
    if "|" in _first_line(spark, path):
        table = _csv(spark, path, "lemma_pos string, ppmi string", "|", header=True)
    else:
        parts = _csv(spark, path, "lemma string, pos string, ppmi string", "\t", header=True)
        table = parts.select(F.concat_ws("_", "lemma", "pos").alias("lemma_pos"), "ppmi")
    return table.withColumn("ppmi", F.from_json("ppmi", T.ArrayType(T.ArrayType(T.DoubleType()))))


def read_scale(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """(category, ppmi): the two ends of a scale, with a header."""
    table = _csv(spark, path, "category string, ppmi string", delimiter, header=True)
    return table.withColumn("ppmi", F.from_json("ppmi", T.ArrayType(T.ArrayType(T.DoubleType()))))


def read_ratings(spark: SparkSession, path: str, form: str, word1: str = "word1", word2: str = "word2",
                 human: str = "human", pos: str = "pos") -> DataFrame:
    """(word1, word2, human[, pos]) as written in the file; see `normalise_ratings` for the forms.

    "NN" and "VB" files have no header and runs of tabs between columns, "suffix" files no header and
    single white space, "pos-column" files a header that names the columns.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if form == "pos-column":
        header = _first_line(spark, path)
        names = [c for c in header.split("\t") if c]
        cells = F.split("value", r"\t+")
        table = lines.filter(F.col("value") != header)
        wanted = {"word1": word1, "word2": word2, "human": human, "pos": pos}
        table = table.select(*[F.get(cells, names.index(c)).alias(n) for n, c in wanted.items()])
    else:
        cells = F.split("value", r"\s" if form == "suffix" else r"\t+")
        table = lines.select(*[F.get(cells, i).alias(n) for i, n in enumerate(("word1", "word2", "human"))])
    return table.withColumn("human", F.col("human").try_cast("double"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(lv_pos, nominal_pos, fvc_pos) from a comma-separated table with a header."""
    table = spark.read.csv(path, header=True)
    return table.select(
        F.col("LV_POS").alias("lv_pos"), F.col("nominal_pos").alias("nominal_pos"), F.col("FVC_POS").alias("fvc_pos")
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(lemma_pos, category) of the words that span a scale."""
    return spark.read.csv(path, header=True).select("lemma_pos", F.col("category").cast("int").alias("category"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(lemma_pos) from a table with a header whose word column is named `word`."""
    return spark.read.csv(path, header=True).select(F.col("word").alias("lemma_pos"))
