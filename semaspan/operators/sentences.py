"""From text lines to sentences of tokens, and sentence-level filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaspan.functions.tokens import anonymise_numerals, has_digit, line_tokens
from semaspan.plans.joins import lookup_join


def tokenised(corpus: DataFrame, value: str = "value", name: str = "ws") -> DataFrame:
    """Replace the line by its array of tokens."""
    return corpus.withColumn(name, line_tokens(F.col(value))).drop(value)


def longer_than(sentences: DataFrame, minimum: int = 5, tokens: str = "ws") -> DataFrame:
    """Sentences with strictly more than `minimum` tokens."""
    return sentences.filter(F.size(tokens) > minimum)


def token_rows(sentences: DataFrame, keys: Sequence[str], tokens: str = "ws", name: str = "lemma_pos") -> DataFrame:
    """One row per token with its position from 0."""
    return sentences.select(*keys, F.posexplode(tokens).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def unique_tokens(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct tokens of lines split at white space or commas."""
    tokens = lines.select(F.explode(F.split(value, r"[\s,]+")).alias("token"))
    return tokens.filter("token <> ''").distinct()


def anonymise_corpus(
    sentences: DataFrame,
    lexicon: DataFrame,
    file: str,
    keys: Sequence[str],
    tokens: str = "ws",
    lemma: str = "lemma",
) -> DataFrame:
    """Put numeral marks into the sentences of each file.

    lexicon: (file, lemma), distinct. A token is a numeral when its lemma has a digit, which is
    decided in place, or is in the lexicon of its file. Only lexicon hits are regrouped, so what is
    collected for a sentence is never more than its own tokens.
    """
    words = (
        sentences.select(*keys, F.explode(F.array_distinct(tokens)).alias("_token"))
        .filter(F.size(F.split("_token", "_")) == 2)
        .select(*keys, F.substring_index("_token", "_", 1).alias(lemma))
        .filter(~has_digit(F.col(lemma)))
    )
    # without digits what remains of a lexicon are number words
    named = lexicon.filter(~has_digit(F.col(lemma))).select(file, lemma)
    hits = (
        lookup_join(words, named, [file, lemma], "left_semi", salts=8)
        .groupBy(*keys)
        .agg(F.collect_set(lemma).alias("_hits"))
    )
    return (
        sentences.join(hits, list(keys), "left")
        .withColumn(tokens, anonymise_numerals(F.col(tokens), F.col("_hits")))
        .drop("_hits")
    )


def all_known(sentences: DataFrame, words: DataFrame, keys: Sequence[str], tokens: str = "ws",
              max_words: int | None = None, word: str = "lemma_pos") -> DataFrame:
    """Keys of the sentences whose tokens are all in `words` or numeral marks.

    A sentence without tokens has no unknown one and stays.
    """
    spelled = sentences.select(*keys, F.explode_outer(F.array_distinct(tokens)).alias(word))
    known = words.select(word).withColumn("_known", F.lit(True))
    checked = lookup_join(spelled, known, word, "left", max_rows=max_words, salts=16)
    fine = F.col("_known").isNotNull() | F.col(word).isNull() | F.col(word).startswith("--anonnumeral_")
    return checked.groupBy(*keys).agg(F.bool_and(fine).alias("_fine")).filter("_fine").drop("_fine")
