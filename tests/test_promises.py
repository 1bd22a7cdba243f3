"""Repeated rows, broken promises, hot keys and written groups."""

import glob

import pytest
from pyspark.sql import functions as F

from semaspan.operators import validation as val
from semaspan.operators.vectors import pair_measures
from semaspan.plans.joins import lookup_join
from semaspan.sources import sinks


def test_repeated_pairs_are_scored_one_by_one(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 2.0), ("b", 1, 2.0)], "lemma_pos string, basis_index int, ppmi double")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "a", 3), ("a", "c", 4)], "word1 string, word2 string, human int")
    got = {r.human: (r.dot, r.euclidean) for r in pair_measures(pairs, cells, ("word1", "word2")).collect()}
    assert got == {1: (6.0, 1.0), 2: (6.0, 1.0), 3: (6.0, 1.0), 4: (0.0, pytest.approx(5**0.5))}


def test_pairs_without_rating_or_score_are_not_ranked(spark):
    rows = [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0), (5.0, 4.0)]
    frame = lambda r: spark.createDataFrame(r, "human double, cosine double")
    plain = val.spearman(frame(rows), ["cosine"]).first()
    assert plain.rho == pytest.approx(0.8) and plain.n == 5
    assert val.spearman(frame([*rows, (None, 2.5), (2.5, None), (None, None)]), ["cosine"]).first() == plain


def test_broken_promise_fails_instead_of_broadcasting(spark):
    stream, table = spark.range(20), spark.range(10).withColumn("x", F.lit(1))
    assert lookup_join(stream, table, "id", max_rows=10).count() == 10
    with pytest.raises(Exception, match="at most 9 rows was promised"):
        lookup_join(stream, table, "id", max_rows=9).count()


def test_hot_key_is_split_by_salts(spark, many_slices):
    stream = spark.range(10_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("k"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(stream, stream.select("k").distinct().withColumn("x", F.lit(1)), "k", salts=32)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == 10_000 and max(sizes) < 4_000


def test_groups_are_written_to_few_files_and_keep_their_keys(spark, tmp_path):
    rows = spark.range(4_000).repartition(8).select(F.lpad(F.col("id") % 50, 3, "0").alias("construction"), F.col("id").cast("string").alias("sentence"))
    folder = f"{tmp_path}/groups"
    sinks.write_groups(rows, folder)
    assert len(glob.glob(f"{folder}/*/*.txt")) == 50
    back = sinks.read_written_groups(spark, folder)
    assert sorted(map(tuple, back.select("construction", "sentence").collect())) == sorted(map(tuple, rows.collect()))
    assert back.filter("construction = '007'").count() == 80
