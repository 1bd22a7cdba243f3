"""Marginals of a count space and positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.plans.joins import lookup_join


def marginals(cells: DataFrame) -> DataFrame:
    """Totals per word, per dimension and over all (`lemma_pos`, `basis_index` null where summed)."""
    return cells.groupingSets(
        [["lemma_pos"], ["basis_index"], []], "lemma_pos", "basis_index"
    ).agg(F.sum("n").alias("total"))


def ppmi(cells: DataFrame, max_basis: int | None = 2_000) -> DataFrame:
    """(lemma_pos, basis_index, ppmi): cells whose observed share exceeds the expected one.

    Column totals have one row per dimension, at most `max_basis`, so they are broadcast and their
    own sum, the grand total, is taken on them. Row totals stay a window inside the one shuffle by word, where a word
    has at most one row per dimension.
    """
    columns = (
        cells.groupBy("basis_index")
        .agg(F.sum("n").alias("_column"))
        .withColumn("_all", F.sum("_column").over(W.partitionBy()))
    )
    rows = cells.withColumn("_row", F.sum("n").over(W.partitionBy("lemma_pos")))
    joint, word, context = F.col("n") / F.col("_all"), F.col("_row") / F.col("_all"), F.col("_column") / F.col("_all")
    return (
        lookup_join(rows, columns, "basis_index", max_rows=max_basis)
        .select("lemma_pos", "basis_index", F.log2(joint / (word * context)).alias("ppmi"))
        .filter("ppmi > 0")
    )
