"""Token frequencies, ranks, basis and target vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.functions.tokens import ANON_NUMERAL, counted_tokens, has_digit
from semaspan.plans.joins import lookup_join
from semaspan.plans.ordered import global_rank, top_ranked


# A task that counts holds about this many different tokens of a batch or of several.
HELD = 1 << 20


def token_frequencies(lines: DataFrame, value: str = "value", tokens: str | None = None,
                      tokenise: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """(lemma_pos, freq) over all lines, or over arrays of tokens if `tokens` names them.

    Partial counts are taken before the shuffle. `tokenise` makes the arrays of a batch of lines, of strings or of
    places in a dictionary without repeats; they are counted where they are made and never become rows.
    """
    if tokenise is not None:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return task_counts((tokenise(batch.column(0)) for batch in batches))

        parts = lines.select(value).mapInArrow(count, "lemma_pos string, n long")
        return parts.groupBy("lemma_pos").agg(F.sum("n").alias("freq"))
    spelled = counted_tokens(F.col(value)) if tokens is None else F.col(tokens)
    return (
        lines.select(F.explode(spelled).alias("lemma_pos"))
        .groupBy("lemma_pos")
        .agg(F.count("*").alias("freq"))
    )


def task_counts(lists: Iterator[pa.ListArray]) -> Iterator[pa.RecordBatch]:
    """(lemma_pos, n) of arrays of token lists, in several parts if there are many different tokens."""
    held, size = [], 0

    def folded() -> pa.Table:
        sums = pa.concat_tables(held).group_by("lemma_pos", use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns({"n_sum": "n"}).select(["lemma_pos", "n"])

    for array in lists:
        encoded = array.flatten().dictionary_encode()
        codes = pc.fill_null(encoded.indices, len(encoded.dictionary)).to_numpy(zero_copy_only=False)
        n = np.bincount(codes, minlength=len(encoded.dictionary) + 1)
        words = pa.concat_arrays([encoded.dictionary, pa.nulls(1, encoded.dictionary.type)])
        held.append(pa.table({"lemma_pos": words, "n": n}).filter(pa.array(n > 0)))
        size += len(held[-1])
        if size > HELD:
            held = [folded()]
            size = len(held[0])
            if size > HELD // 2:
                yield from held[0].to_batches(max_chunksize=100_000)
                held, size = [], 0
    if held:
        yield from folded().to_batches(max_chunksize=100_000)


def most_frequent_first(freqs: DataFrame) -> list[Column]:
    """The order of a frequency list: its own rank, else frequency and then token, both falling."""
    if "rank" in freqs.columns:
        return [F.col("rank").asc()]
    return [F.col("freq").desc(), F.col("lemma_pos").desc()]


def ranked_frequencies(freqs: DataFrame) -> DataFrame:
    """(rank, freq, lemma_pos), rank 1 for the most frequent token."""
    unranked = freqs.select("freq", "lemma_pos")
    return global_rank(unranked, most_frequent_first(unranked)).select("rank", "freq", "lemma_pos")


def fold_numerals(freqs: DataFrame, lexicon: DataFrame, ranked: bool = True) -> DataFrame:
    """Sum all numerals of one tag into one numeral mark and rank again.

    lexicon: distinct lemmas known to be numerals. Tokens without exactly one lemma and one tag, and
    the pronoun `one_PRON`, stay as they are. A mark that the list already holds joins the sum.
    """
    parts = F.split(F.btrim("lemma_pos", F.lit(" _")), "_")
    split = freqs.select(
        "freq",
        "lemma_pos",
        F.when((F.size(parts) == 2) & (F.col("lemma_pos") != "one_PRON"), parts).alias("_parts"),
    ).select("freq", "lemma_pos", F.col("_parts")[0].alias("lemma"), F.col("_parts")[1].alias("tag"))
    # tokens without a lemma are looked up by themselves, as nulls would all meet in one task; what they find is not used
    keyed = split.withColumn("_key", F.coalesce("lemma", F.concat(F.lit(" "), "lemma_pos")))
    known = lexicon.select(F.col("lemma").alias("_key")).withColumn("_numeral", F.lit(True))
    marked = lookup_join(keyed, known, "_key", "left")
    numeral = F.col("lemma").isNotNull() & (has_digit(F.col("lemma")) | F.col("_numeral").isNotNull())
    folded = (
        marked.select("freq", F.when(numeral, F.concat(F.lit(ANON_NUMERAL + "_"), "tag")).otherwise(F.col("lemma_pos")).alias("lemma_pos"))
        .groupBy("lemma_pos")
        .agg(F.sum("freq").alias("freq"))
    )
    return ranked_frequencies(folded) if ranked else folded


# Which tokens may name a context dimension.
BASIS_SHAPE = r"^(--anon|[a-zA-Z])+_[A-Z]+$"
BASIS_CLOSED_CLASS = r"_(STOP|PREP|PRON|CONJ)"
BASIS_SINGLE_LETTER = r"^[a-z]_[A-Z]+$"


def select_basis(freqs: DataFrame, dimension: int = 2000, exclude_first: int = 50) -> DataFrame:
    """(basis_index, lemma_pos): the context dimensions, at most `dimension` rows."""
    eligible = freqs.filter(
        F.col("lemma_pos").rlike(BASIS_SHAPE)
        & ~F.col("lemma_pos").rlike(BASIS_CLOSED_CLASS)
        & ~F.col("lemma_pos").rlike(BASIS_SINGLE_LETTER)
    )
    best = top_ranked(eligible, most_frequent_first(freqs), exclude_first + dimension, "_place", 0)
    return best.filter(F.col("_place") >= exclude_first).select(
        (F.col("_place") - exclude_first).cast("int").alias("basis_index"), "lemma_pos"
    )


def target_words(freqs: DataFrame, freq_threshold: int = 50, vocabulary_size: int = 50_000) -> DataFrame:
    """(voc_index, lemma_pos): the words that get a vector, at most `vocabulary_size` rows."""
    frequent = freqs.filter(F.col("freq") >= freq_threshold)
    best = top_ranked(frequent, most_frequent_first(freqs), vocabulary_size, "_place", 0)
    return best.select(F.col("_place").cast("int").alias("voc_index"), "lemma_pos")


def keep_vocabulary(tokens: DataFrame, vocabulary: DataFrame, max_words: int | None = None,
                    how: str = "inner", token: str = "lemma_pos") -> DataFrame:
    """Token rows with the vocabulary's columns; broadcast when `max_words` bounds the vocabulary."""
    return lookup_join(tokens, vocabulary, token, how, max_rows=max_words, salts=16)
