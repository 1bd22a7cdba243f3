"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and tokens, one stage after the other.

Each stage takes (spark, docs, sf_dir) and gives back what it keeps; `run` writes each result as Parquet in
the shared folder and reads it as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspan.llm import bpe, mixing, near_copies, quality_rules, secrets, simhash
from semaspan.llm.queries import PATTERN, RANKS
from semaspan.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A mix of the kept documents that draws nine tenths of their tokens, with large sources and languages held back.
MIX_BUDGET, MIX_TEMPER = 0.9, 0.7


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.kept_documents(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles: the one with the smallest doc_id, and one row of it if it is repeated.

    What SimHash puts in one component is a candidate, and so is what shares a MinHash band; each candidate is compared exactly.
    """
    spelled = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))
    keyed = docs.select(*COLUMNS, F.md5(spelled.cast("binary")).alias("_row"))  # equal rows share it
    named = keyed.select(F.struct("doc_id", "_row").alias("doc_id"), "text")
    linked = simhash.near_duplicates(named).select("doc_id", F.xxhash64("component_id").alias("key"))
    groups = near_copies.near_copies(named, linked)
    first = groups.select(F.col("component_id._row").alias("_row")).distinct()
    return keyed.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their lengths counted anew."""
    found = secrets.with_secrets(docs.select(*COLUMNS), secrets="_secrets")
    text = secrets.masked("text", "_secrets")
    hidden = found.withColumn("text", F.when(F.size("_secrets") > 0, text).otherwise(F.col("text"))).drop("_secrets")
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target shares."""
    return mixing.sampled(docs.select(*COLUMNS), budget=MIX_BUDGET, temper=MIX_TEMPER)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text back."""
    tokens = bpe.with_tokens(docs.select(*COLUMNS), RANKS, PATTERN)
    whole = bpe.decode(F.col("token_ids"), RANKS, PATTERN) == F.coalesce("text", F.lit("")).cast("binary")
    return tokens.select(
        "doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), whole.alias("round_trip")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_by_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

ORACLE_SQL = None  # near copies, raking and merges have no SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
