"""Length and score summaries, outliers and reshaping of grouped values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaspan.functions.tokens import sentence_length
from semaspan.plans.joins import lookup_join
from semaspan.plans.ordered import global_rank, group_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def sentence_lengths(sentences: DataFrame, sentence: str = "sentence", name: str = "length") -> DataFrame:
    """Add the number of tokens between white space."""
    return sentences.withColumn(name, sentence_length(F.col(sentence)).cast("long"))


def length_summary(lengths: DataFrame, construction: str = "construction", kind: str = "kind",
                   length: str = "length") -> DataFrame:
    """count, min, q1, median, mean, sd, q3, max per construction, per kind and over all.

    Lengths are whole numbers, so rows are first folded to one row per (group, length); the exact
    quantiles then hold no more values than there are different lengths.
    """
    counts = lengths.groupBy(construction, kind, length).agg(F.count("*").alias("_n"))
    levels = counts.groupingSets([[construction, kind], [kind], []], construction, kind)
    quartiles = F.percentile(F.col(length), F.lit([0.25, 0.5, 0.75]), F.col("_n"))
    x, n = F.col(length).cast("double"), F.col("_n")
    size, total = F.sum("_n"), F.sum(x * n)
    # exact whole-number sums keep this form of the variance accurate
    variance = (F.sum(x * x * n) - total * total / size) / (size - 1)
    level = F.when(F.grouping(construction) == 0, "construction").when(F.grouping(kind) == 0, "kind").otherwise("all")
    return levels.agg(
        level.alias("level"),
        size.alias("n"),
        F.min(length).cast("double").alias("min"),
        quartiles.alias("_q"),
        (total / size).alias("mean"),
        F.when(size > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sd"),
        F.max(length).cast("double").alias("max"),
    ).select(
        "level", construction, kind, "n", "min",
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), "mean", "sd", F.col("_q")[2].alias("q3"), "max",
    )


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, min, q1, median, mean, q3, max) of numeric columns; one without values has n = 0 and nulls."""
    named = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(named).alias("_c")).select("_c.*")
    spread = long.groupBy("variable").agg(F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"))
    return spread.join(group_quantiles(long, ["variable"], "x", QUARTILES), "variable", "left").select(
        "variable", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "min", "q1", "median", "mean", "q3", "max"
    )


def flag_outliers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add is_outlier (beyond 1.5 interquartile ranges) and is_extreme (beyond 3)."""
    fences = group_quantiles(df, groups, value, {"_q1": 0.25, "_q3": 0.75}).drop("n")
    if groups:
        joined = lookup_join(df, fences, list(groups), salts=8)
    else:
        joined = df.select("*", fences.select(F.struct("_q1", "_q3")).scalar().alias("_f")).select("*", "_f.*").drop("_f")
    spread, x = F.col("_q3") - F.col("_q1"), F.col(value)

    def beyond(times: float):
        return (x < F.col("_q1") - times * spread) | (x > F.col("_q3") + times * spread)

    return joined.select(*df.columns, beyond(1.5).alias("is_outlier"), beyond(3.0).alias("is_extreme"))


def outliers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return flag_outliers(df, groups, value).filter("is_outlier").drop("is_outlier")


def remove_outliers(df: DataFrame, groups: Sequence[str], value: str, mode: str) -> DataFrame:
    """mode "none", "extreme" or "all". Flags depend on the value only, so equal values go together; nulls stay."""
    if mode == "none":
        return df
    flag = {"extreme": "is_extreme", "all": "is_outlier"}[mode]
    return flag_outliers(df, groups, value).filter(~F.coalesce(F.col(flag), F.lit(False))).select(df.columns)


def pair_notes(scores: DataFrame, mode: str, pair: str = "pair", kind: str = "kind", score: str = "score") -> DataFrame:
    """(pair, note, fvc_n, lvc_n) after outlier removal in the given mode.

    "insufficient observations" if a side keeps fewer than two rows. Otherwise extremes that were
    found and not all asked to go are announced before what was removed.
    """
    flagged = flag_outliers(scores, [pair, kind], score)
    removed = {"none": F.lit(False), "extreme": F.col("is_extreme"), "all": F.col("is_outlier")}[mode]
    removed = F.coalesce(removed, F.lit(False))  # a null score is no outlier
    sides = flagged.groupBy(pair).agg(
        F.count_if((F.col(kind) == "FVC") & ~removed).alias("fvc_n"),
        F.count_if((F.col(kind) == "LVC") & ~removed).alias("lvc_n"),
        F.bool_or("is_extreme").alias("_extremes"),
    )
    if mode == "extreme":
        note = F.when(F.col("_extremes"), "EXTREME OUTLIERS REMOVED").otherwise("")
    else:
        note = F.when(F.col("_extremes"), "EXTREME OUTLIERS PRESENT").otherwise("ALL OUTLIERS REMOVED" if mode == "all" else "")
    few = (F.col("fvc_n") < 2) | (F.col("lvc_n") < 2)
    return sides.select(pair, F.when(few, "insufficient observations").otherwise(note).alias("note"), "fvc_n", "lvc_n")


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Number the rows from 0 in the given order, so that reshaped rows can be told apart."""
    return global_rank(df, order, name, start=0)


def wide_to_long(df: DataFrame, key: str, columns: Sequence[str], name: str = "construction", value: str = "projection") -> DataFrame:
    """One row per (key, column)."""
    return df.unpivot([key], list(columns), name, value)


def paired_differences(df: DataFrame, first: str, second: str, name: str = "difference") -> DataFrame:
    """Add first - second and the outlier flags of that difference."""
    return flag_outliers(df.withColumn(name, F.col(first) - F.col(second)), [], name)
