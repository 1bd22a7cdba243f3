"""Sparse vectors in long form (lemma_pos, basis_index, value) and measures between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.functions.dense import COSINE_FLOOR
from semaspan.plans.joins import lookup_join


def to_long(vectors: DataFrame, nested: str, value: str, key: str = "lemma_pos") -> DataFrame:
    """One row per stored cell from nested [[index, value], ...] or array<struct>."""
    as_arrays = dict(vectors.dtypes)[nested].startswith("array<array")
    cells = vectors.select(key, F.explode(nested).alias("_cell"))
    if as_arrays:
        index, number = F.col("_cell")[0], F.col("_cell")[1]
    else:
        index, number = F.col("_cell")["basis_index"], F.col("_cell")[value]
    return cells.select(key, index.cast("int").alias("basis_index"), number.alias(value))


def to_nested(cells: DataFrame, value: str, name: str | None = None, key: str = "lemma_pos") -> DataFrame:
    """[[index, value], ...] per word, by rising index; no longer than the basis dimension."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("basis_index").cast("double").alias("i"), F.col(value).cast("double").alias("x"))))
    nested = F.transform(pairs, lambda p: F.array(p["i"], p["x"]))
    return cells.groupBy(key).agg(nested.alias(name or value))


def vectors_of(vectors: DataFrame, words: DataFrame, max_words: int | None = None) -> DataFrame:
    """Rows of `vectors` whose word is in `words`."""
    return lookup_join(vectors, words.select("lemma_pos").distinct(), "lemma_pos", "left_semi", max_rows=max_words)


def subset_dimensions(cells: DataFrame, dimensions: DataFrame, max_basis: int | None = 2_000) -> DataFrame:
    """Keep the listed dimensions and number them by their place in the list.

    dimensions: (basis_index, new_index).
    """
    kept = lookup_join(cells, dimensions.select("basis_index", "new_index"), "basis_index", max_rows=max_basis)
    return kept.drop("basis_index").withColumnRenamed("new_index", "basis_index").select(cells.columns)


def sparse_vectors(cells: DataFrame, value: str = "ppmi", key: str = "lemma_pos") -> DataFrame:
    """(key, indices, values, square): one row a word, dimensions rising, and the sum of its squared values.

    Repeated cells of a dimension are summed, null values left out. A row is no longer than the basis.
    """
    sums = cells.filter(F.col(value).isNotNull()).groupBy(key, "basis_index").agg(F.sum(value).cast("double").alias("x"))
    packed = F.sort_array(F.collect_list(F.struct("basis_index", "x")))
    rows = sums.groupBy(key).agg(packed.alias("_cells"), F.sum(F.col("x") * F.col("x")).alias("square"))
    return rows.select(key, F.col("_cells.basis_index").alias("indices"), F.col("_cells.x").alias("values"), "square")


def _merged(i1: str, x1: str, i2: str, x2: str) -> Column:
    """(dot, far) of two sparse vectors: both are walked once, always on at the smaller dimension.

    `far` is the squared distance, summed from differences, so that it is exact for equal vectors.
    """

    def step(state: Column, _: Column) -> Column:
        p, q = F.get(i1, state["a"]), F.get(i2, state["b"])
        first, second = p.isNotNull() & (q.isNull() | (p <= q)), q.isNotNull() & (p.isNull() | (q <= p))
        x = F.when(first, F.get(x1, state["a"])).otherwise(0.0)
        y = F.when(second, F.get(x2, state["b"])).otherwise(0.0)
        return F.struct(
            (state["a"] + first.cast("int")).alias("a"), (state["b"] + second.cast("int")).alias("b"),
            (state["dot"] + x * y).alias("dot"), (state["far"] + (x - y) * (x - y)).alias("far"),
        )

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("far"))
    # from 0, as a sequence from 1 to 0 would fall; the step too many finds nothing
    return F.aggregate(F.sequence(F.lit(0), F.size(i1) + F.size(i2)), start, step)


def pair_measures(
    pairs: DataFrame,
    cells: DataFrame,
    key: Sequence[str],
    value: str = "ppmi",
    left: str = "word1",
    right: str = "word2",
    floor: float = COSINE_FLOOR,
) -> DataFrame:
    """dot, cosine and euclidean for each pair of words, from one row a word.

    Rows that list the same two words get the same numbers, whatever their key.
    Only words of the pairs are packed into sparse vectors; a pair meets its two vectors and merges them in the
    row, so no cell is joined or shuffled for a pair. Words without cells count as zero vectors.
    """
    words = [left, right]
    asked = pairs.select(*words).distinct()
    used = asked.select(F.explode(F.array(*words)).alias("lemma_pos")).distinct()
    vectors = sparse_vectors(cells.join(used, "lemma_pos", "left_semi"), value)
    met = asked
    for n, word in enumerate(words, 1):
        side = vectors.select(
            F.col("lemma_pos").alias(word), F.col("indices").alias(f"_i{n}"), F.col("values").alias(f"_x{n}"), F.col("square").alias(f"_s{n}")
        )
        met = lookup_join(met, side, word, "left", salts=8)
    for n in (1, 2):
        met = met.withColumns({
            f"_i{n}": F.coalesce(f"_i{n}", F.array().cast(met.schema[f"_i{n}"].dataType)),
            f"_x{n}": F.coalesce(f"_x{n}", F.array().cast("array<double>")),
            f"_s{n}": F.coalesce(f"_s{n}", F.lit(0.0)),
        })
    sums = met.select(*words, _merged("_i1", "_x1", "_i2", "_x2").alias("_sums"), (F.sqrt("_s1") * F.sqrt("_s2")).alias("_norms"))
    sums = sums.select(*words, F.col("_sums.dot").alias("_dot"), F.col("_sums.far").alias("_far"), "_norms")
    full = lookup_join(pairs, sums, words, "left", salts=8).na.fill(0.0, ["_dot", "_far", "_norms"])
    return full.select(
        *pairs.columns,
        F.col("_dot").alias("dot"),
        (F.col("_dot") / F.greatest("_norms", F.lit(floor))).alias("cosine"),
        F.sqrt("_far").alias("euclidean"),
    )


def norms(cells: DataFrame, value: str = "ppmi", key: str = "lemma_pos") -> DataFrame:
    return cells.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
