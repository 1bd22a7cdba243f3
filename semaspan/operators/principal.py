"""Principal components of long-form vectors of any width, by block power iteration.

A block of directions is multiplied by the vectors and by their transpose in turn: two sparse products, each a join
of the cells with a table of one row a dimension or a vector, and a grouped sum. Between them only matrices of the
block's width reach the driver: there the block is orthogonalised, and the best directions inside it are found
(Rayleigh and Ritz). No matrix of the dimension squared is built anywhere. Vectors are centred by arithmetic on
sums, so cells that are zero stay absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.plans.joins import lookup_join
from semaspan.session import stored

BLOCK = 64  # directions that are iterated together; spaces of fewer dimensions are solved in one round
ROUNDS = 400
CLOSE = 1e-10  # the residual of a component against the largest eigenvalue when the iteration ends
TABLE_ROWS = 20_000  # rows of a factor that is broadcast: 10 MB


def _product(cells: DataFrame, factor: DataFrame, on: str, by: str, width: int, rows: int) -> DataFrame:
    """(by, p, total): sums of the cells' values times the factor's rows, and of the values."""
    laid = lookup_join(cells, factor.select(on, "p"), on, max_rows=rows if rows <= TABLE_ROWS else None, salts=8)
    x = F.col("x")
    sums = [F.sum(x * F.col("p")[j]).alias(f"p{j}") for j in range(width)]
    summed = laid.select(by, "x", "p").groupBy(by).agg(F.sum("x").alias("total"), *sums)
    return summed.select(by, F.array(*[f"p{j}" for j in range(width)]).alias("p"), "total")


def _moments(df: DataFrame, column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The products of an array column's places summed over all rows, and the sums of its places."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().reshape(-1, width)
            total[:width] += rows.T @ rows
            total[width] += rows.sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype=np.int32), "x": total.ravel()})

    found = df.select(column).mapInArrow(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros((width + 1) * width)
    total[found.column("at").to_numpy()] = found.column("x").to_numpy()
    total = total.reshape(width + 1, width)
    return total[:width], total[width]


def _best(square: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, of `square` over directions with inner products `inner`, and the directions' mixtures."""
    size, axes = np.linalg.eigh(inner)
    kept = size > 1e-13 * max(size.max(initial=0.0), 1e-300)
    white = axes[:, kept] / np.sqrt(size[kept])
    value, mix = np.linalg.eigh(white.T @ square @ white)
    return value[::-1], (white @ mix)[:, ::-1]


def _mixed(df: DataFrame, keep: list[str], mixtures: dict[str, list[tuple[str, np.ndarray]]]) -> DataFrame:
    """`keep`, and for each name the sum of array columns times matrices."""
    kinds = dict(df.dtypes)
    sources = sorted({c for parts in mixtures.values() for c, _ in parts})

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in sources}
            made = []
            for parts in mixtures.values():
                x = sum(rows[c] @ m for c, m in parts)
                made.append(pa.array(list(x), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *mixtures])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} array<double>" for c in mixtures)])
    return df.select(*keep, *sources).mapInArrow(mix, schema)


def principal_scores(cells: DataFrame, rows: DataFrame, k: int, key: str = "row", index: str = "i", value: str = "x") -> DataFrame:
    """(key, scores): the first `k` principal components of each row, as an array.

    cells: (key, index, value) with at most one cell for each place; absent and null ones are zero. rows: (key), once
    each, those without cells too. The sign of a component is free; here its largest loading is positive, of equal
    ones that of the smallest index. Components beyond the rank are zero. Raises if ROUNDS rounds leave a residual
    above CLOSE, as when the k-th eigenvalue equals many others.
    """
    rows = stored(rows.select(key))
    n = rows.count()
    held = cells.select(key, F.col(index).alias("i"), F.col(value).cast("double").alias("x")).filter("x <> 0").join(rows, key, "left_semi")
    held = stored(held)
    dims = stored(held.groupBy("i").agg(F.sum("x").alias("total")))
    d = dims.count()
    if not n or not d:
        return rows.select(key, F.array(*[F.lit(0.0)] * k).alias("scores"))
    width = min(BLOCK, d)
    start = [F.xxhash64("i", F.lit(j)) / F.lit(2.0**63) for j in range(width)]
    v = stored(dims.select("i", F.array(*start).alias("p")))
    inner, _ = _moments(v, "p", width)
    for _ in range(ROUNDS):
        zero = F.array(*[F.lit(0.0)] * width)
        y = rows.join(_product(held, v, "i", key, width, d).select(key, "p"), key, "left").select(key, F.coalesce("p", zero).alias("p"))
        y = stored(y)
        square, sums = _moments(y, "p", width)
        centre = sums / n  # of all rows' products, as a factor of each row
        values, mix = _best(square - n * np.outer(centre, centre), inner)
        top, kept = min(k, len(values)), max(1, int((values > 1e-14 * max(values[0], 1e-300)).sum()))
        back = _product(held, y, key, "i", width, n).withColumnRenamed("p", "w")
        both = back.select("i", "w", F.array("total").alias("s")).join(v, "i")
        # the transposed product of the centred vectors, mixed; and what it lacks of being the directions themselves
        turned = [("w", mix[:, :kept] / np.maximum(values[:kept], 1e-300)), ("s", -(centre @ mix[:, :kept] / np.maximum(values[:kept], 1e-300))[None, :])]
        lacking = [("w", mix[:, :top]), ("s", -(centre @ mix[:, :top])[None, :]), ("p", -mix[:, :top] * values[:top])]
        v_next = stored(_mixed(both, ["i"], {"next": turned, "residual": lacking, "loading": [("p", mix[:, :top])]}))
        residual = np.sqrt(np.diag(_moments(v_next, "residual", top)[0]))
        if (residual <= CLOSE * max(values[0], 1e-300)).all() or values[0] <= 0:
            break
        v, width = v_next.select("i", F.col("next").alias("p")), kept
        inner, _ = _moments(v, "p", width)
    else:
        raise ValueError(f"principal components did not settle: residuals {residual / values[0]} of the largest eigenvalue after {ROUNDS} rounds")
    largest = [F.max_by(F.col("loading")[j], F.struct(F.abs(F.col("loading")[j]), -F.col("i"))).alias(f"l{j}") for j in range(top)]
    signs = np.array([1.0 if x is None or x >= 0 else -1.0 for x in v_next.agg(*largest).first()])
    scores = _mixed(y.withColumn("one", F.array(F.lit(1.0))), [key], {"scores": [("p", mix[:, :top] * signs), ("one", -(centre @ mix[:, :top] * signs)[None, :])]})
    lacks = [F.lit(0.0)] * (k - top)
    return scores.select(key, F.concat("scores", F.array(*lacks)).alias("scores") if lacks else "scores")


def place(array: Column) -> Column:
    """(i, x) of each place of an array of numbers."""
    return F.posexplode(array.cast("array<double>"))
