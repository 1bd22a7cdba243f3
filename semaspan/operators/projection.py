"""Projection of words, pairs and sentences onto a semantic scale between two word groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspan.operators.principal import place, principal_scores
from semaspan.operators.vectors import sparse_vectors
from semaspan.plans.joins import listed, lookup_join
from semaspan.session import stored


def category_means(seeds: DataFrame, cells: DataFrame, value: str = "ppmi") -> DataFrame:
    """(category, basis_index, mean): summed seed vectors over the number of seeds.

    A seed without a cell in some dimension counts as zero there, so this is not an average of cells.
    """
    sizes = seeds.groupBy("category").agg(F.count("*").alias("_members"))
    sums = (
        seeds.join(cells, "lemma_pos")
        .groupBy("category", "basis_index")
        .agg(F.sum(value).alias("_sum"))
    )
    return sums.join(sizes, "category").select(
        "category", "basis_index", (F.col("_sum") / F.col("_members")).alias("mean")
    )


def scale_vector(seeds: DataFrame, cells: DataFrame, positive_category: int = 1, value: str = "ppmi") -> DataFrame:
    """(basis_index, weight, unit): mean of the positive category minus mean of the other one.

    `unit` is the weight divided by the scale's length. Use positive_category=1 for words and pairs,
    2 for sentences. The scale has at most as many rows as the basis has dimensions.
    """
    sign = F.when(F.col("category") == positive_category, F.lit(1.0)).otherwise(F.lit(-1.0))
    scale = (
        category_means(seeds, cells, value)
        .groupBy("basis_index")
        .agg(F.sum(sign * F.col("mean")).alias("weight"))
    )
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy()))
    return scale.select("basis_index", "weight", F.try_divide("weight", length).alias("unit"))


def project_cells(cells: DataFrame, scale: DataFrame, key: str | Sequence[str] = "lemma_pos", value: str = "ppmi",
                  max_basis: int | None = 2_000) -> DataFrame:
    """(key, projection) of every vector that shares a dimension with the scale."""
    keys = [key] if isinstance(key, str) else list(key)
    on_scale = lookup_join(cells, scale.select("basis_index", "unit"), "basis_index", max_rows=max_basis)
    return on_scale.groupBy(*keys).agg(F.sum(F.col(value) * F.col("unit")).alias("projection"))


def word_projections(words: DataFrame, cells: DataFrame, scale: DataFrame, value: str = "ppmi",
                     max_basis: int | None = 2_000) -> DataFrame:
    """(lemma_pos, projection) for the words of the space; a word without cells projects to 0."""
    projected = project_cells(cells, scale, "lemma_pos", value, max_basis)
    return words.select("lemma_pos").join(projected, "lemma_pos", "left").na.fill(0.0, ["projection"])


def project_word_list(word_list: DataFrame, projections: DataFrame, max_words: int | None = None) -> DataFrame:
    """(lemma_pos, found, projection): listed words the space lacks are reported, not dropped."""
    known = projections.withColumn("_found", F.lit(True))
    joined = lookup_join(word_list.select("lemma_pos"), known, "lemma_pos", "left", max_rows=max_words)
    return joined.select("lemma_pos", F.col("_found").isNotNull().alias("found"), "projection")


PAIR_ROLES = ("fvc_pos", "lv_pos", "nominal_pos")


def _role_projections(pairs: DataFrame, projections: DataFrame, max_words: int | None) -> DataFrame:
    joined = pairs.select(*PAIR_ROLES)
    for role in PAIR_ROLES:
        table = projections.select(F.col("lemma_pos").alias(role), F.col("projection").alias(f"_{role}"))
        joined = lookup_join(joined, table, role, "left", max_rows=max_words, salts=8)
    return joined


def pair_projections(pairs: DataFrame, projections: DataFrame, mode: str = "roles",
                     max_words: int | None = None) -> DataFrame:
    """Projection of the plain verb, and of the light verb plus its noun, for each pair.

    The projection of a sum of vectors is the sum of their projections, so words are projected once
    and pairs only add numbers. mode "compat" also skips pairs whose three words are not distinct.
    """
    joined = _role_projections(pairs, projections, max_words)
    keep = F.lit(True)
    for role in PAIR_ROLES:
        keep = keep & F.col(f"_{role}").isNotNull()
    if mode == "compat":
        fvc, lv, noun = (F.col(r) for r in PAIR_ROLES)
        keep = keep & (fvc != lv) & (fvc != noun) & (lv != noun)
    return joined.filter(keep).select(
        F.col("fvc_pos").alias("fvc"),
        F.col("_fvc_pos").alias("fvc_projection"),
        F.col("lv_pos").alias("lv"),
        F.col("nominal_pos").alias("lv_noun"),
        (F.col("_lv_pos") + F.col("_nominal_pos")).alias("lvc_projection"),
    )


def missing_pair_words(pairs: DataFrame, words: DataFrame, max_words: int | None = None) -> DataFrame:
    """Words of the pairs that the space lacks: once per pair, repeated over pairs."""
    roles = pairs.select(F.explode(F.array_distinct(F.array(*PAIR_ROLES))).alias("lemma_pos"))
    return lookup_join(roles, words.select("lemma_pos"), "lemma_pos", "left_anti", max_rows=max_words, salts=8)


def sentence_vectors(sentences: DataFrame, cells: DataFrame, words: DataFrame, keys: Sequence[str],
                     tokens: str = "ws", value: str = "ppmi", max_words: int | None = None) -> DataFrame:
    """(keys, basis_index, value) summed over the tokens of each sentence, repeats included.

    A sentence with an unknown token is dropped. A sentence without tokens has the zero vector: one
    row with a null dimension and value 0, which a sentence whose words all lack cells gets as well.

    Sentences are dealt to blocks, and a word's vector goes to the blocks that use it, once each. So numbers of words
    move and no cell of a sentence: its vector is summed in the block, and is opened after its last shuffle.
    """
    vectors = words.select("lemma_pos").distinct().join(sparse_vectors(cells, value).drop("square"), "lemma_pos", "left")
    vectors = stored(vectors.withColumn("_word", F.monotonically_increasing_id()))
    spelled = sentences.select(*keys, F.explode_outer(tokens).alias("lemma_pos"))
    met = lookup_join(spelled, vectors.select("lemma_pos", "_word"), "lemma_pos", "left", max_rows=max_words, salts=16)
    fine = F.bool_and(F.col("_word").isNotNull() | F.col("lemma_pos").isNull())
    known = met.groupBy(*keys).agg(fine.alias("_fine"), F.collect_list("_word").alias("_words"))
    known = stored(known.filter("_fine").drop("_fine"))
    asked = known.agg(F.sum(F.size("_words"))).first()[0] or 0
    blocks = max(known.sparkSession.sparkContext.defaultParallelism, -(-asked // BLOCK_TOKENS))
    dealt = known.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    used = dealt.select("_block", F.explode("_words").alias("_word")).distinct()
    sent = used.join(vectors.filter(F.size("indices") > 0).select("_word", "indices", "values"), "_word")
    sent = sent.select("_block", F.array("_word").alias("_words"), "indices", "values")
    both = sent.unionByName(dealt, allowMissingColumns=True).select(*keys, "_block", "_words", "indices", "values")
    # the vectors of a block come before its sentences
    rows = both.repartition(blocks, "_block").sortWithinPartitions("_block", F.col("values").isNull())
    schema = T.StructType([both.schema[k] for k in [*keys, "indices", "values"]])
    cell = F.inline(F.arrays_zip("indices", "values")).alias("basis_index", value)
    return rows.mapInArrow(_block_sums(list(keys)), schema).select(*keys, cell)


BLOCK_TOKENS = 8_000_000  # tokens of a block, about; a task holds the vectors of their words
CELLS_AT_ONCE = 2_000_000


def _block_sums(keys: list[str]):
    """From rows (keys, _block, _words, indices, values), a block's vectors before its sentences, to the sentences' sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, table = None, [], None
        for batch in batches:
            numbers = batch["_block"].to_numpy()
            vector = batch["values"].is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((numbers[1:] != numbers[:-1]) | (vector[1:] != vector[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, len(numbers)]):
                if a == b:
                    continue
                if numbers[a] != block:
                    block, held, table = numbers[a], [], None
                part = batch.slice(a, b - a)
                if vector[a]:
                    held.append(part.select(["_words", "indices", "values"]))
                    continue
                if table is None:
                    table, held = _SparseTable(held, batch.schema), []
                yield from _summed(part, keys, table)

    return sums


class _SparseTable:
    """Vectors of words by number: where each one's cells start, how many there are, and the cells."""

    def __init__(self, parts: list[pa.RecordBatch], schema: pa.Schema):
        def joined(name: str) -> np.ndarray:
            found = [p[name].flatten() for p in parts]
            return pa.chunked_array(found, schema.field(name).type.value_type).to_numpy()

        self.names = joined("_words")
        counts = np.concatenate([np.zeros(0, np.int64), *[p["indices"].value_lengths().to_numpy() for p in parts]]).astype(np.int64)
        starts = np.cumsum(counts) - counts
        order = np.argsort(self.names, kind="stable")
        self.names, self.starts, self.counts = self.names[order], starts[order], counts[order]
        self.dims, self.cells = np.unique(joined("indices"), return_inverse=True)
        self.values = joined("values")

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of the cells of each word; none for a word without a vector."""
        if not len(self.names):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        return self.starts[at], np.where(self.names[at] == words, self.counts[at], 0)


def _summed(part: pa.RecordBatch, keys: list[str], table: _SparseTable) -> Iterator[pa.RecordBatch]:
    lengths = part["_words"].value_lengths().to_numpy().astype(np.int64)
    starts, counts = table.find(part["_words"].flatten().to_numpy())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    cells = np.bincount(owner, counts, len(lengths))
    # few sentences at once, so that neither their words' cells nor their own sums are many
    share = np.cumsum(np.maximum(cells, len(table.dims))) // CELLS_AT_ONCE
    edges = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1), len(lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in zip(edges[:-1], edges[1:]):
        words = slice(ends[a], ends[b])
        times, n = counts[words], b - a
        first = np.repeat(starts[words] - (np.cumsum(times) - times), times)
        place = first + np.arange(len(first))
        key = np.repeat(owner[words] - a, times) * len(table.dims) + table.cells[place]
        size = n * len(table.dims)
        found = np.flatnonzero(np.bincount(key, minlength=size))
        total = np.bincount(key, table.values[place], size)[found]
        rows, dims = (found // len(table.dims), table.dims[found % len(table.dims)]) if size else (found, table.dims)
        empty = np.setdiff1d(np.arange(n), rows)  # these have the zero vector: a null dimension
        order = np.argsort(np.concatenate([rows, empty]), kind="stable")
        null = np.concatenate([np.zeros(len(rows), bool), np.ones(len(empty), bool)])[order]
        dims = np.concatenate([dims, np.zeros(len(empty), dims.dtype)])[order]
        total = np.concatenate([total, np.zeros(len(empty))])[order]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([rows, empty]), minlength=n))]), pa.int32())
        indices = pa.array(dims, part.schema.field("indices").type.value_type, mask=null)
        chunk = part.slice(a, n)
        yield pa.RecordBatch.from_arrays(
            [*[chunk[k] for k in keys], pa.ListArray.from_arrays(offsets, indices), pa.ListArray.from_arrays(offsets, pa.array(total))],
            [*keys, "indices", "values"],
        )


def sentence_projections(sentences: DataFrame, projections: DataFrame, keys: Sequence[str], tokens: str = "ws",
                         max_words: int | None = None, tokenise: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """(keys, projection) of the sentences whose tokens all have a vector.

    Sums the projections of the words instead of projecting the summed vectors. A sentence without
    tokens scores 0; rows with equal keys are one sentence. Words of a promised number go to every task, which sums a
    sentence where it is read, so no token becomes a row; others are joined. `tokenise` makes the arrays of tokens of a batch
    from the lines that `tokens` names, as in `cooccurrences`.
    """
    words = listed(projections.select("lemma_pos", "projection"), max_words)
    if words is not None:
        score = F.arrow_udf(lambda batch: token_sums(batch if tokenise is None else tokenise(batch), words), _SCORE).asNondeterministic()
        scored = sentences.select(*keys, score(tokens).alias("_s")).select(*keys, F.col("_s.fine").alias("_known"), F.col("_s.projection"))
    else:
        if tokenise is not None:
            made = F.arrow_udf(lambda lines: tokenise(lines).cast(pa.list_(pa.string())), T.ArrayType(T.StringType())).asNondeterministic()
            sentences = sentences.select(*keys, made(tokens).alias(tokens))
        spelled = sentences.select(*keys, F.explode_outer(tokens).alias("lemma_pos"))
        scored = lookup_join(spelled, projections, "lemma_pos", "left", max_rows=max_words, salts=16)
        scored = scored.withColumn("_known", F.col("projection").isNotNull() | F.col("lemma_pos").isNull())
    return (
        scored.groupBy(*keys)
        .agg(F.bool_and("_known").alias("_fine"), F.coalesce(F.sum("projection"), F.lit(0.0)).alias("projection"))
        .filter("_fine")
        .drop("_fine")
    )


_SCORE = T.StructType().add("fine", T.BooleanType()).add("projection", T.DoubleType())


def token_sums(lists: pa.ListArray, words: pa.Table) -> pa.StructArray:
    """(fine, projection) of arrays of tokens, of strings or of places in a dictionary: whether all have a projection, and their sum.

    A null token adds nothing, nor does a null array.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    encoded = flat if pa.types.is_dictionary(flat.type) else flat.dictionary_encode()
    # of each different token, and of null behind them
    at = pc.index_in(encoded.dictionary, words["lemma_pos"].combine_chunks())
    found = words["projection"].combine_chunks().cast(pa.float64()).take(at)
    unknown = np.append(found.is_null().to_numpy(zero_copy_only=False), False)
    value = np.append(pc.fill_null(found, 0.0).to_numpy(zero_copy_only=False), 0.0)
    codes = pc.fill_null(encoded.indices, len(found)).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.bincount(owner, unknown[codes], len(sizes)) == 0
    total = np.bincount(owner, value[codes], len(sizes)).astype(np.float64)
    return pa.StructArray.from_arrays([pa.array(fine), pa.array(total)], _SCORE.names)


def scale_endpoints(means: DataFrame, scale: DataFrame, max_basis: int | None = 2_000) -> DataFrame:
    """(category, projection): the two category means on their own scale."""
    return project_cells(means, scale, "category", "mean", max_basis)


def dense_vectors(cells: DataFrame, words: DataFrame, dimension: int, value: str = "ppmi",
                  key: str = "lemma_pos") -> DataFrame:
    """(key, features): arrays of length `dimension` for PCA, zero where a word has no cell."""
    place = F.struct(F.col("basis_index").cast("int").alias("i"), F.col(value).cast("double").alias("x"))
    pairs = cells.groupBy(key).agg(F.array_sort(F.collect_list(place)).alias("_pairs"))

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), n)

    def filled(pair: Column, nth: Column) -> Column:
        before = F.when(nth > 0, F.get("_pairs", nth - 1)["i"]).otherwise(-1)
        return F.concat(zeros(pair["i"] - before - 1), F.array(pair["x"]))

    last = F.get("_pairs", F.size("_pairs") - 1)["i"]
    rows = F.concat(F.transform("_pairs", filled), F.array(zeros(F.lit(dimension - 1) - last)))
    joined = words.select(key).join(pairs, key, "left")
    return joined.select(key, F.when(F.col("_pairs").isNull(), zeros(F.lit(dimension))).otherwise(F.flatten(rows)).alias("features"))


def with_scale_ends(cells: DataFrame, means: DataFrame, value: str = "ppmi", key: str = "lemma_pos") -> DataFrame:
    """Cells of words, and those of the two category means under the names scale_end_1 and scale_end_2."""
    ends = means.select(F.concat(F.lit("scale_end_"), F.col("category").cast("string")).alias(key), "basis_index", F.col("mean").alias(value))
    return cells.select(key, "basis_index", value).unionByName(ends)


def pca_2d(vectors: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, pc1, pc2): centred vectors on their first two principal components, for arrays of any length.

    Each row is a vector of its own, also where keys repeat. The sign of a component is free; here its largest
    loading is positive.
    """
    rows = stored(vectors.select(key, features).withColumn("row", F.monotonically_increasing_id()))
    cells = rows.select("row", place(F.col(features)).alias("i", "x"))
    scores = principal_scores(cells, rows, 2)
    return rows.select("row", key).join(scores, "row").select(key, *[F.col("scores")[c].alias(f"pc{c + 1}") for c in (0, 1)])


def pca_of_cells(cells: DataFrame, words: DataFrame, value: str = "ppmi", key: str = "lemma_pos") -> DataFrame:
    """(key, pc1, pc2) of the listed words, once each, straight from their cells; a word without cells is the zero vector."""
    scores = principal_scores(cells, words.select(key).distinct(), 2, key, "basis_index", value)
    return scores.select(key, *[F.col("scores")[c].alias(f"pc{c + 1}") for c in (0, 1)])
