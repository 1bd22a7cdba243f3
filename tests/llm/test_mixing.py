import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from semaspan.llm import mixing


def slow_rake(tokens, goals):
    weight = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    for _ in range(500):
        for axis, goal in enumerate(goals):
            for value, share in goal.items():
                total = sum(w for k, w in weight.items() if k[axis] == value)
                for k in weight:
                    if k[axis] == value:
                        weight[k] *= share / total
    return weight


CELLS = {k: 10 + 7 * i % 90 for i, k in enumerate(itertools.product(("s1", "s2", None), ("en", "de"), ("a", "b")))}
TARGETS = {"source": {"s1": 0.2}, "lang": {"en": 0.3, "de": 0.7}}


@pytest.mark.parametrize("on_driver", [200_000, 0])
def test_raking_against_brute_force(spark, monkeypatch, on_driver):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", on_driver)
    monkeypatch.setattr(mixing, "ROUNDS", 60 if on_driver else 6)
    cells = spark.createDataFrame([(*k, n) for k, n in CELLS.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r for r in mixing.rates(cells, TARGETS, 0.4).collect()}
    sums = [{v: sum(n for k, n in CELLS.items() if k[axis] == v) for v in {k[axis] for k in CELLS}} for axis in range(3)]
    goals = [mixing.shares(s, TARGETS.get(d), 0.5) for s, d in zip(sums, mixing.DIMENSIONS)]
    want = slow_rake(CELLS, goals)
    for k, w in want.items():
        assert got[k].weight == pytest.approx(w, abs=1e-9 if on_driver else 1e-4)
    assert sum(r.rate * r.tokens for r in got.values()) == pytest.approx(0.4 * sum(CELLS.values()), rel=1e-6)
    assert all(0 <= r.rate <= 1 for r in got.values())
    assert sum(w for k, w in want.items() if k[0] == "s1") == pytest.approx(0.2)


def test_sample_meets_targets(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 10, F.lit(3))).alias("source"),
        F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.repeat(F.lit("word "), 20).alias("text"),
    )
    rows = mixing.mixed(docs, {"source": {"s0": 0.25, "s1": 0.25, "s2": 0.25, "s3": 0.25}, "lang": {"en": 0.5, "de": 0.5}}, 0.2).filter("drawn")
    by = rows.groupBy("source").count().toPandas().set_index("source")["count"]
    assert (abs(by / by.sum() - 0.25) < 0.02).all() and abs(by.sum() / 8_000 - 1) < 0.05


def test_odd_rows(spark):
    rows = [(1, None, None, None, 1.0), (1, None, None, None, 1.0), (2, "", "s", "en", 2.0), (None, "a b", "s", "en", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate double")
    got = mixing.mixed(docs, budget=1.0).collect()
    assert len(got) == 4 and sorted(r.tokens for r in got) == [0, 0, 0, 2] and [r.drawn for r in got if r.tokens] == [True]
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert isinstance(mixing.raked_rows(pd.DataFrame({"source": [], "lang": [], "topic": [], "tokens": []}), {d: {} for d in mixing.DIMENSIONS}), np.ndarray)
