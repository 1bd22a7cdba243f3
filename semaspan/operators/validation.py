"""Validation of a vector space against human ratings of word pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.functions.distributions import t_two_sided
from semaspan.operators.vectors import pair_measures
from semaspan.plans.joins import lookup_join
from semaspan.plans.ordered import mid_ranks
from semaspan.session import settle

MEASURES = ("cosine", "euclidean", "dot")


def _tag(code: Column, noun: str, adjective: str | None) -> Column:
    """Coarse tag of a one- or two-letter tag code; everything else is a verb."""
    tag = F.when(code == noun, "SUBST")
    if adjective is not None:
        tag = tag.when(code == adjective, "ADJ")
    return tag.otherwise("VERB")


def normalise_ratings(ratings: DataFrame, form: str, word1: str = "word1", word2: str = "word2",
                      human: str = "human", pos: str = "pos") -> DataFrame:
    """(word1, word2, human) with words as lower-case lemma_TAG.

    form: "NN" or "VB" for one tag for all words, "pos-column" for a tag column N/A/V,
    "suffix" for words written lemma-n, lemma-j or lemma-v.
    """
    if form in ("NN", "VB"):
        def token(c: str) -> Column:
            return F.concat(F.lower(c), F.lit("_"), _tag(F.lit(form), "NN", None))
    elif form == "pos-column":
        def token(c: str) -> Column:
            return F.concat(F.lower(c), F.lit("_"), _tag(F.col(pos), "N", "A"))
    elif form == "suffix":
        def token(c: str) -> Column:
            parts = F.split(c, "-")
            return F.concat(F.lower(parts[0]), F.lit("_"), _tag(parts[1], "n", "j"))
    else:
        raise ValueError(f"unknown form of ratings: {form}")
    return ratings.select(token(word1).alias("word1"), token(word2).alias("word2"), F.col(human).cast("double").alias("human"))


def with_known_flags(ratings: DataFrame, words: DataFrame, max_words: int | None = None) -> DataFrame:
    """Ratings with known1 and known2: does the space have the word?"""
    flagged = ratings
    for side in ("1", "2"):
        known = words.select(F.col("lemma_pos").alias(f"word{side}")).withColumn(f"known{side}", F.lit(True))
        flagged = lookup_join(flagged, known, f"word{side}", "left", max_rows=max_words, salts=8)
    return flagged.na.fill(False, ["known1", "known2"]).select(*ratings.columns, "known1", "known2")


def pair_scores(ratings: DataFrame, cells: DataFrame, words: DataFrame, value: str = "ppmi",
                key: Sequence[str] = ("word1", "word2"), max_words: int | None = None) -> DataFrame:
    """Cosine, Euclidean distance and dot product of the pairs whose words both have a vector."""
    found = with_known_flags(ratings, words, max_words).filter("known1 AND known2").drop("known1", "known2")
    return pair_measures(found, cells, key, value)


def spearman(scores: DataFrame, measures: Sequence[str] = MEASURES, human: str = "human") -> DataFrame:
    """(measure, n, rho, p_value) of each measure against the human ratings.

    Pairs that lack a rating or a score take no part. Ties share their average rank. Ranks are joined back by value; rho is the correlation of the two
    rank columns, its two-sided p comes from Student's t with n - 2 degrees of freedom.
    """
    named = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_score")) for m in measures])
    long = scores.select(F.col(human).cast("double").alias("_human"), F.explode(named).alias("_m"))
    # adding 0.0 makes a negative zero equal to zero in joins and groups
    long = long.select((F.col("_human") + 0.0).alias("_human"), "_m.measure", (F.col("_m._score") + 0.0).alias("_score"))
    long = long.filter(F.col("_human").isNotNull() & F.col("_score").isNotNull())
    long = settle(long)  # read for two rankings and for the join of the ranks
    model = mid_ranks(long, ["measure"], "_score", "_model_rank").drop("n")
    people = mid_ranks(long, ["measure"], "_human", "_human_rank").drop("n")
    # ratings have few different values, and many scores are zero
    ranked = lookup_join(long, model, ["measure", "_score"], salts=8)
    ranked = lookup_join(ranked, people, ["measure", "_human"], salts=8)
    rho = ranked.groupBy("measure").agg(
        F.count("*").alias("n"), F.corr("_model_rank", "_human_rank").alias("rho")
    )
    return with_spearman_p(rho)


def with_spearman_p(rho: DataFrame) -> DataFrame:
    """Add the two-sided p of a rank correlation `rho` over `n` pairs; null below three pairs."""
    df = (F.col("n") - 2).cast("double")
    t = F.col("rho") * F.sqrt(F.try_divide(df, (1 - F.col("rho")) * (1 + F.col("rho"))))
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(t_two_sided(t, df))
    return rho.withColumn("p_value", F.when(F.col("n") > 2, p))


def coverage(ratings: DataFrame, words: DataFrame, max_words: int | None = None) -> DataFrame:
    """One row: pairs, pairs_scored, percent_scored, words_missing (distinct)."""
    flagged = with_known_flags(ratings, words, max_words)
    sides = F.array(
        F.when(~F.col("known1"), F.col("word1")), F.when(~F.col("known2"), F.col("word2"))
    )
    pairs = flagged.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("known1") & F.col("known2")).alias("pairs_scored")
    )
    missing = flagged.select(F.explode(sides).alias("_word")).agg(F.count_distinct("_word").alias("words_missing"))
    return pairs.select(
        "pairs",
        "pairs_scored",
        F.round(F.try_divide(F.col("pairs_scored"), F.col("pairs")) * 100, 2).alias("percent_scored"),
        missing.scalar().alias("words_missing"),
    )


def missing_rating_words(ratings: DataFrame, words: DataFrame, max_words: int | None = None) -> DataFrame:
    """Distinct rated words that the space does not have."""
    rated = ratings.select(F.explode(F.array("word1", "word2")).alias("lemma_pos")).distinct()
    return lookup_join(rated, words.select("lemma_pos"), "lemma_pos", "left_anti", max_rows=max_words)
