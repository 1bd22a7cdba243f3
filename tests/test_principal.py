"""Principal components without a covariance matrix, against a singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaspan.operators import principal
from semaspan.operators.projection import pca_2d, pca_of_cells


def want(x, k=2):
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    return centred @ np.array([a * np.sign(a[np.argmax(np.abs(a))]) for a in axes[:k]]).T


def cells_of(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "row long, i int, x double"), spark.range(len(x)).select(F.col("id").alias("row"))


def found(spark, x, k=2):
    cells, rows = cells_of(spark, x)
    got = {r.row: r.scores for r in principal.principal_scores(cells, rows, k).collect()}
    return np.array([got[i] for i in range(len(x))])


def test_more_dimensions_than_a_driver_could_square(spark):
    rng = np.random.default_rng(5)
    x = np.zeros((120, 20_000))
    at = rng.integers(0, 20_000, (120, 60))
    np.put_along_axis(x, at, rng.random((120, 60)), 1)
    x[:, :40] += np.outer(rng.normal(size=120) * 3, rng.normal(size=40)) + np.outer(rng.normal(size=120) * 2, rng.normal(size=40))
    x[7] = 0  # a row without cells
    assert np.allclose(found(spark, x), want(x), atol=1e-7)


def test_iteration_over_blocks_narrower_than_the_space(spark, monkeypatch):
    monkeypatch.setattr(principal, "BLOCK", 4)
    monkeypatch.setattr(principal, "TABLE_ROWS", 3)  # factors are shuffled
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12)) * (0.5 ** np.arange(12)) + 5
    assert np.allclose(found(spark, x), want(x), atol=1e-6)
    monkeypatch.setattr(principal, "ROUNDS", 1)
    with pytest.raises(ValueError, match="did not settle"):
        found(spark, x)


def test_low_rank_equal_and_missing_rows(spark):
    assert np.allclose(found(spark, np.outer(np.arange(5.0), [1.0, 2.0])), want(np.outer(np.arange(5.0), [1.0, 2.0]), 1) * [1, 0])
    assert np.allclose(found(spark, np.ones((4, 3))), 0) and np.allclose(found(spark, np.ones((1, 3))), 0)
    cells, rows = cells_of(spark, np.eye(3))
    assert principal.principal_scores(cells, rows.limit(0), 2).count() == 0
    assert [r.scores for r in principal.principal_scores(cells.limit(0), rows, 2).collect()] == [[0.0, 0.0]] * 3


def test_repeated_keys_and_words_without_cells(spark):
    x = np.array([[1.0, 2.0, 0.5], [2.0, 1.0, 3.0], [2.0, 1.0, 3.0], [9.0, 0.0, 1.0]])
    df = spark.createDataFrame([(0, x[0].tolist()), (1, x[1].tolist()), (1, x[2].tolist()), (2, x[3].tolist())], "id int, features array<double>")
    got = sorted((r.id, round(r.pc1, 9), round(r.pc2, 9)) for r in pca_2d(df, "id").collect())
    assert got == sorted((i, round(a, 9), round(b, 9)) for i, (a, b) in zip((0, 1, 1, 2), want(x)))
    cells = spark.createDataFrame([("a", 4, 1.0), ("a", 9, 2.0), ("b", 9, 3.0), ("other", 4, 50.0), ("b", 4, None)], "lemma_pos string, basis_index int, ppmi double")
    words = spark.createDataFrame([("a",), ("b",), ("none",), ("a",)], "lemma_pos string")
    got = {r.lemma_pos: (r.pc1, r.pc2) for r in pca_of_cells(cells, words).collect()}
    assert np.allclose([got["a"], got["b"], got["none"]], want(np.array([[1.0, 2.0], [0.0, 3.0], [0.0, 0.0]])))
