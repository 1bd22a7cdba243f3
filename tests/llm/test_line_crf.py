import itertools

import numpy as np
from pyspark.sql import functions as F

from semaspan.llm import line_crf as crf
from semaspan.llm.queries import QUERIES


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    scores, chain, length = rng.normal(size=(3, 5, 2)), rng.normal(size=(2, 2)), np.array([5, 1, 3])
    lines, pairs, total = crf.marginals(scores, length, chain)
    for d, n in enumerate(length):
        weight, share, joint = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(scores[d, t, y[t]] for t in range(n)) + sum(chain[y[t - 1], y[t]] for t in range(1, n)))
            weight += p
            for t in range(n):
                share[t, y[t]] += p
            for t in range(1, n):
                joint[y[t - 1], y[t]] += p
        assert np.allclose(lines[d, :n], share / weight) and np.allclose(lines[d, n:], 0)
        assert np.allclose(pairs[d], joint / weight) and np.isclose(total[d], np.log(weight))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op4_line_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    for label in (0, 1):
        of = [r.predicted for r in rows if r.quality == label]
        assert len(of) > 50 and sum(p == label for p in of) / len(of) >= 0.95, (label, sum(p == label for p in of) / len(of))


def test_held_out_rule_and_odd_rows(spark):
    import zlib

    ids = spark.range(300).select("id", crf.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)
    docs = spark.createDataFrame([(1, "A good line.\n\nAnother.", 0), (2, None, 0), (2, "", 0), (None, "x " * 50_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = crf.learned(docs, labels)
    scores = [r.s for r in docs.select(crf.quality("text", model).alias("s")).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert docs.limit(0).select(crf.quality("text", crf.learned(docs.limit(0), labels)).alias("s")).count() == 0
