"""Ordered passes and lookups against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaspan.plans.joins import lookup_join
from semaspan.plans.ordered import global_rank, group_quantiles, mid_ranks, ordered, running, top_ranked


@pytest.fixture
def skewed(spark):
    """One group holds most of the rows."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", float(rng.randrange(60)), i) for i in range(900)]
    return rows, spark.createDataFrame(rows, "g string, v double, i long").repartition(5)


def test_global_rank(many_slices, skewed):
    rows, df = skewed
    got = {r.i: r["rank"] for r in global_rank(df, [F.col("v").desc(), F.col("i").desc()]).collect()}
    want = {i: n + 1 for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], -r[2])))}
    assert got == want
    assert ordered(df, ["v", "i"]).select("_slice").distinct().count() > 1


@pytest.mark.parametrize("n", [25, 20_000])
def test_top_ranked_by_heap_and_by_sort(many_slices, skewed, n):
    rows, df = skewed
    got = {r.i: r["rank"] for r in top_ranked(df, [F.col("v").desc(), F.col("i").desc()], n, start=0).collect()}
    want = {i: k for k, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], -r[2]))[:n])}
    assert got == want


def test_running_sum_and_minimum_cross_slices(many_slices, skewed):
    rows, df = skewed
    rows_in_order = ordered(df, ["g", "i"])
    got = {r.i: (r.total, r.low) for r in running(rows_in_order, ["g"], {"total": ("sum", "v"), "low": ("min", "v")}).collect()}
    total, low, want = defaultdict(float), defaultdict(lambda: 1e9), {}
    for g, v, i in sorted(rows, key=lambda r: (r[0], r[2])):
        total[g] += v
        low[g] = min(low[g], v)
        want[i] = (total[g], low[g])
    assert got == want


def test_mid_ranks(many_slices, skewed):
    rows, df = skewed
    got = {(r.g, r.v): r.mid_rank for r in mid_ranks(df, ["g"], "v").collect()}
    by_group = defaultdict(list)
    for g, v, _ in rows:
        by_group[g].append(v)
    for g, values in by_group.items():
        for v, n in Counter(values).items():
            assert got[(g, v)] == sum(x < v for x in values) + (n + 1) / 2


def test_group_quantiles(many_slices, skewed):
    rows, df = skewed
    by_group = defaultdict(list)
    for g, v, _ in rows:
        by_group[g].append(v)
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "x": 0.9, "z": 1.0}
    for r in group_quantiles(df, ["g"], "v", probs).collect():
        assert r.n == len(by_group[r.g])
        for name, q in probs.items():
            assert r[name] == pytest.approx(np.quantile(by_group[r.g], q))
    whole = group_quantiles(df, [], "v", probs).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.quantile([r[1] for r in rows], 0.5))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_plans_agree(spark, skewed, how):
    _, df = skewed
    table = spark.createDataFrame([("hot", 1), ("g1", 2), ("g2", 3), ("other", 4)], "g string, x int")
    results = [
        sorted(map(str, lookup_join(df, table, "g", how, **plan).select(sorted(df.columns)).collect()))
        for plan in ({"max_rows": 4}, {}, {"salts": 5}, {"max_rows": 10**9, "salts": 3})
    ]
    assert all(r == results[0] for r in results)


def test_bounded_tables_are_broadcast_and_unbounded_ones_are_not_forced(spark):
    stream = spark.range(1000).withColumn("k", F.col("id") % 10)
    table = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    hinted = lookup_join(stream, table, "k", max_rows=10)._jdf.queryExecution().analyzed().toString()
    free = lookup_join(stream, table, "k", salts=4)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted or "broadcast" in hinted.lower()
    assert "ResolvedHint" not in free and "_salt" in free


def test_quantiles_of_values_of_all_magnitudes(spark, many_slices):
    rng = np.random.default_rng(8)
    wide = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, float("inf")]])
    near = 1.0 + rng.integers(0, 400, 500) * 2.0**-52  # neighbouring doubles
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "x": 0.9, "z": 1.0}
    for group in (wide, near, np.array([3.0]), np.full(50, -2.5), rng.integers(-9, 9, 400).astype(float)):
        rows = [("hot", float(x)) for x in group] + [("few", 1.0), ("few", 2.0), ("hot", None), (None, 4.0)]
        got = {r.g: r for r in group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()}
        assert set(got) == {"hot", "few"} and got["few"].m == 1.5 and got["hot"].n == len(group)
        with np.errstate(invalid="ignore"):
            for name, q in probs.items():
                spot, ranked = (len(group) - 1) * q, np.sort(group)
                low, high = ranked[int(np.floor(spot))], ranked[int(np.ceil(spot))]
                want = low if spot == np.floor(spot) else low + (spot - np.floor(spot)) * (high - low)
                assert got["hot"][name] == pytest.approx(want, rel=1e-15), (name, group[:3])
    assert group_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", probs).count() == 0


def test_quantiles_sort_no_values(spark):
    """Only buckets are put in order, and a group of most rows is folded before the shuffle."""
    df = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 10 < 7, "hot").otherwise("rest").alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    found = group_quantiles(df, ["g"], "v", {"m": 0.5})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort " not in plan
    values = [i * 7919 % 100_003 for i in range(200_000)]
    got = {r.g: r.m for r in found.collect()}
    assert got == {"hot": np.median([v for i, v in enumerate(values) if i % 10 < 7]), "rest": np.median([v for i, v in enumerate(values) if i % 10 >= 7])}
