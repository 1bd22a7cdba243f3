"""Windowed co-occurrence counts and their assembly into vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspan.plans.joins import listed, lookup_join

# A task that counts holds about this many cells, key values and neighbours of context words at once.
HELD = 1 << 22


def cooccurrences(
    sentences: DataFrame,
    targets: DataFrame,
    basis: DataFrame,
    window: int = 5,
    min_length: int = 5,
    tokens: str = "ws",
    keys: Sequence[str] = (),
    max_targets: int | None = 50_000,
    max_basis: int | None = 2_000,
    tokenise: Callable[[pa.Array], pa.Array] | None = None,
) -> DataFrame:
    """(keys, lemma_pos, basis_index, n): how often a context word stands near a target word.

    Counts every pair of positions of one sentence at most `window` apart, except pairs of the same
    word. The window is symmetric, so it is opened around the context words: they are the smaller share
    of a corpus, as the basis leaves out the most frequent words. Bounded vocabularies go to every task, which counts
    whole batches of sentences and folds their cells before anything moves; others are joined, each context
    word with its own neighbourhood of at most 2 * window + 1 tokens. `tokenise` makes the arrays of tokens of a
    batch from the lines that `tokens` names, of strings or of places in a dictionary without repeats; they are
    counted where they are made.
    """
    voc, dims = targets.select("lemma_pos", "voc_index"), basis.select("lemma_pos", "basis_index")
    bounded = [listed(table, rows) for table, rows in ((voc, max_targets), (dims, max_basis))]
    if any(table is None for table in bounded):
        if tokenise is not None:
            spelled = pa.list_(pa.string())
            made = F.arrow_udf(lambda lines: tokenise(lines).cast(spelled), T.ArrayType(T.StringType())).asNondeterministic()
            sentences = sentences.select(*keys, made(tokens).alias(tokens))
        pairs = _joined_pairs(sentences, voc, dims, window, min_length, tokens, keys, max_targets, max_basis)
        parts = pairs.withColumn("n", F.lit(1))
    else:
        parts = _counted_pairs(sentences.select(*keys, tokens), *bounded, voc.schema, dims.schema, window, min_length, tokenise)
    cells = parts.groupBy(*keys, "voc_index", "basis_index").agg(F.sum("n").alias("n"))
    return lookup_join(cells, voc, "voc_index", max_rows=max_targets, salts=16).select(
        *keys, "lemma_pos", "basis_index", "n"
    )


def _joined_pairs(sentences, voc, dims, window, min_length, tokens, keys, max_targets, max_basis) -> DataFrame:
    """(keys, voc_index, basis_index): one row a pair, from joins with both vocabularies."""
    at = F.col("_at")
    start = F.greatest(at - window + 1, F.lit(1))  # slice positions count from 1
    # short sentences become null here: as a filter the condition would tokenise every line again
    placed = sentences.select(*keys, tokens).select(
        *keys, tokens, F.posexplode(F.when(F.size(tokens) > min_length, F.col(tokens))).alias("_at", "_context")
    )
    near = placed.select(*keys, "_context", F.slice(tokens, start, at + window + 2 - start).alias("_near"))
    # a computed key: Spark would copy the basis' pattern filters to every token of the corpus
    named = dims.select(F.concat(F.lit(""), "lemma_pos").alias("_context"), "basis_index")
    hits = lookup_join(near, named, "_context", max_rows=max_basis, salts=16)
    pairs = hits.select(*keys, "basis_index", F.explode(F.array_remove("_near", F.col("_context"))).alias("lemma_pos"))
    return lookup_join(pairs, voc, "lemma_pos", max_rows=max_targets, salts=16).select(*keys, "voc_index", "basis_index")


def _counted_pairs(sentences, words, contexts, word_schema, context_schema, window, min_length, tokenise) -> DataFrame:
    """(keys, voc_index, basis_index, n): the pairs of a task, folded, in several parts if there are many."""
    schema = T.StructType([
        *sentences.schema[:-1], word_schema["voc_index"], context_schema["basis_index"], T.StructField("n", T.LongType()),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task_cells(_with_tokens(batches, tokenise), words, contexts, window, min_length)

    return sentences.mapInArrow(count, schema)


def task_cells(batches: Iterator[pa.RecordBatch], words: pa.Table, contexts: pa.Table, window: int, min_length: int) -> Iterator[pa.RecordBatch]:
    """Cells of batches of (keys, tokens); a cell is numbered by its key values, its word and its dimension."""
    groups: dict[tuple, int] = {}
    held, size, schema = [], 0, None
    for batch in _bounded(batches):
        schema = batch.schema
        rows = list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) or [()] * len(batch)
        group = np.array([groups.setdefault(r, len(groups)) for r in rows], np.int64)
        for cells, n in _pairs(batch.column(batch.num_columns - 1), group, words, contexts, window, min_length):
            held.append((cells, n))
            size += len(cells)
            if size > HELD:
                held = [_folded(held)]
                size = len(held[0][0])
        if size > HELD // 2 or len(groups) > HELD:
            yield from _cell_rows(held, groups, schema, words, contexts)
            groups, held, size = {}, [], 0
    if held:
        yield from _cell_rows(held, groups, schema, words, contexts)


def _with_tokens(batches: Iterator[pa.RecordBatch], tokenise: Callable[[pa.Array], pa.Array] | None) -> Iterator[pa.RecordBatch]:
    """The batches with tokens made of their last column."""
    for batch in batches:
        if tokenise is not None:
            batch = pa.RecordBatch.from_arrays([*batch.columns[:-1], tokenise(batch.columns[-1])], batch.schema.names)
        yield batch


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about HELD tokens, one sentence at least."""
    for batch in batches:
        part = np.cumsum(_sizes(batch.column(batch.num_columns - 1))) // HELD
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def _pairs(lists: pa.ListArray, group: np.ndarray, words: pa.Table, contexts: pa.Table, window: int, min_length: int):
    """(cells, n) of parts of a batch of token lists."""
    sizes = _sizes(lists)
    encoded = lists.flatten().dictionary_encode()
    codes = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)

    def places(table: pa.Table) -> np.ndarray:
        """The place in the table of each token, -1 for others and for null."""
        found = pc.index_in(encoded.dictionary, table["lemma_pos"].combine_chunks())
        return np.append(pc.fill_null(found, -1).to_numpy(zero_copy_only=False), -1)[codes]

    word, context = places(words), places(contexts)
    ends = np.cumsum(sizes)
    line = np.repeat(np.arange(len(sizes)), np.where(sizes > min_length, sizes, 0))
    # of the tokens in sentences that are long enough, those that name a dimension
    long = np.flatnonzero(np.repeat(sizes > min_length, sizes))
    named = context[long] >= 0
    at, line = long[named], line[named]
    part = max(1, HELD // (2 * window + 1))
    for i in range(0, len(at), part):
        middle, of = at[i : i + part], line[i : i + part]
        first, last = ends[of] - sizes[of], ends[of] - 1
        base = group[of] * len(words)
        cells = []
        for step in (*range(-window, 0), *range(1, window + 1)):
            near = middle + step
            inside = np.flatnonzero((near >= first) & (near <= last))
            near = near[inside]
            inside = inside[(word[near] >= 0) & (codes[near] != codes[middle[inside]])]
            cells.append((base[inside] + word[middle[inside] + step]) * len(contexts) + context[middle[inside]])
        yield np.unique(np.concatenate(cells), return_counts=True)


def _folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    return cells[starts], np.add.reduceat(counts, starts) if len(cells) else counts


def _cell_rows(held, groups: dict[tuple, int], schema: pa.Schema, words: pa.Table, contexts: pa.Table) -> Iterator[pa.RecordBatch]:
    cells, n = _folded(held)
    rest, dim = np.divmod(cells, len(contexts)) if len(contexts) else (cells, cells)
    group, word = np.divmod(rest, len(words)) if len(words) else (rest, rest)
    values = [pa.array(v, f.type) for v, f in zip(zip(*groups), schema)]
    columns = [v.take(pa.array(group)) for v in values]
    columns += [words["voc_index"].combine_chunks().take(pa.array(word)), contexts["basis_index"].combine_chunks().take(pa.array(dim))]
    names = [*schema.names[:-1], "voc_index", "basis_index", "n"]
    table = pa.Table.from_arrays([*columns, pa.array(n.astype(np.int64))], names)
    yield from table.to_batches(max_chunksize=100_000)


def vector_sum(cells: DataFrame, value: str = "n") -> DataFrame:
    """Add up vectors that hold several rows for one (word, dimension)."""
    return cells.groupBy("lemma_pos", "basis_index").agg(F.sum(value).alias(value))


def assemble_vectors(cells: DataFrame, targets: DataFrame, value: str = "n", name: str = "vector") -> DataFrame:
    """(voc_index, lemma_pos, vector): one row per target, pairs by rising dimension.

    A vector has at most as many pairs as the basis has dimensions. Words without cells keep an
    empty vector.
    """
    vectors = cells.groupBy("lemma_pos").agg(
        F.array_sort(F.collect_list(F.struct("basis_index", value))).alias(name)
    )
    joined = targets.select("voc_index", "lemma_pos").join(vectors, "lemma_pos", "left")
    empty = F.filter(F.array(F.struct(F.lit(0).alias("basis_index"), F.lit(0).cast(dict(cells.dtypes)[value]).alias(value))), lambda _: F.lit(False))
    return joined.select("voc_index", "lemma_pos", F.coalesce(name, empty).alias(name))
