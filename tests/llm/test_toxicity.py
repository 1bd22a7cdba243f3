import numpy as np
import pytest
from pyspark.sql import functions as F

from semaspan.llm import toxicity as tx
from semaspan.llm.line_crf import held_out
from semaspan.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op12_toxicity"](spark, sf)
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    for label, least in ((0, 0.96), (1, 0.85)):
        of = [r.predicted for r in rows if r.toxic == label]
        assert len(of) > 50 and sum(p == label for p in of) / len(of) >= least, (label, sum(p == label for p in of) / len(of))


def test_risk_is_that_of_labelled_data_and_steps_back_below_zero():
    rng = np.random.default_rng(3)
    n, prior = 200_000, 0.3
    y = rng.random(n) < prior  # the unlabelled sample, with labels that the risk never sees
    s = rng.normal(size=n) + y
    positive = rng.normal(size=n) + 1
    scores, confirmed = np.concatenate([positive, s]), np.arange(2 * n) < n
    a, b, c = tx.risk(scores, confirmed, prior)
    labelled = np.where(y, np.logaddexp(0, -s), np.logaddexp(0, s)).mean()
    assert a + c - b == pytest.approx(labelled, abs=0.01)
    # the slope against differences of the risk, on both sides of zero
    for scores in (rng.normal(size=30), np.where(np.arange(30) < 10, 3.0, -9.0)):
        confirmed = np.arange(30) < 10
        a, b, c = tx.risk(scores, confirmed, prior)
        got = tx.slope(scores, confirmed, prior)
        for i in range(30):
            moved = scores + 1e-6 * (np.arange(30) == i)
            x, y, z = tx.risk(moved, confirmed, prior)
            change = ((x + z - y) - (a + c - b)) / 1e-6 if c >= b else -((z - y) - (c - b)) / 1e-6
            assert got[i] == pytest.approx(change, abs=1e-5)
    assert c < b


def test_copies_and_odd_rows(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"good plain words number {letters(i)} and more of them", "x") for i in range(200)]
    rows += [(1000 + i, f"you vile wretch number {letters(1000 + i)} and more of them", "x") for i in range(100)]
    odd = [(None, "vile", "x"), (5, None, "x"), (6, "", "x"), (7, "vile " * 200_000, "x"), (7, "vile " * 200_000, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(100)] + [(i, 0) for i in range(200)] + [(None, 1), (3, None), (99_999, 1), (8, 7)], "doc_id long, toxic int")
    model = tx.learned(docs, labels)
    got = [(r.doc_id, r.s) for r in docs.select("doc_id", tx.toxicity("text", model).alias("s")).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for _, s in got)
    clean = [s for d, s in got if d is not None and 10 <= d < 200]
    assert max(clean) < 0.5 < min(s for d, s in got if d is not None and d >= 1000)
    assert model.weights == tx.learned(docs.unionByName(docs), labels.unionByName(labels)).weights
    # nothing to learn from: the prior
    for d, l in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.filter("toxic = 0"))):
        empty = tx.learned(d, l, prior=0.2)
        assert docs.limit(3).select(tx.toxicity("text", empty).alias("s")).first().s == pytest.approx(0.2)
    assert docs.limit(0).select(tx.toxicity("text", model).alias("s")).count() == 0


def test_labels_of_held_out_documents_are_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    lies = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.learned(docs, labels).weights == tx.learned(docs, lies).weights
