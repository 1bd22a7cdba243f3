import math

import numpy as np
from pyspark.sql import functions as F

from semaspan.llm import neighbours as nn


def brute(ids, v, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        out[q] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]
    return out


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = nn.usable(table)
    got = {}
    for r in nn.search(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = vectors.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    want = brute(ids, v, [i for i in ids.tolist() if i % 20 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        truth = dict(best)
        hits += sum(i in truth for _, i, _ in found)
        for _, i, score in found:
            assert score == math.sqrt(((v[ids == i][0] - v[ids == q][0]) ** 2).sum())
    assert hits / (10 * len(want)) >= 0.9, hits / (10 * len(want))


def test_odd_vectors_ties_and_repeats(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]),
        (6, [1.0, float("nan")]), (7, [float("inf"), 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]),
    ]
    vectors = nn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = nn.search(vectors, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, 1.0)]
    assert nn.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hot_list_is_parted(spark, monkeypatch):
    monkeypatch.setattr(nn, "SHARE", 50)
    random = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(1, 400)] + [(i, random.normal(size=3).tolist()) for i in range(400, 1400)]
    vectors = nn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nn.search(vectors, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11)) and all(r.score == 0 for r in got)


def searched_and_recall(spark, v):
    """Share of the vectors that lie in the lists a query searches, and the recall over 80 or more queries."""
    ids = np.arange(len(v))
    table = nn.usable(spark.createDataFrame(list(zip(ids.tolist(), v.tolist())), "vec_id long, embedding array<double>"))
    sample = nn.sampled(table)
    centroids = nn.fitted(sample, len(v))
    held = nn.lists_of_vectors(v, centroids)
    asked = nn.lists_of_queries(v[::100], nn.CentroidGraph(centroids), *nn.fitted_ratio(sample, centroids))
    share = np.mean([np.mean([bool(set(lists) & set(near)) for lists in held]) for near in asked])
    got = nn.search(table, F.col("vec_id") % 100 == 0).collect()
    want = brute(ids, v, range(0, len(v), 100))
    hits = sum(r.vec_id in dict(want[r.query_id]) for r in got)
    return share, hits / (10 * len(want))


def test_ratio_alone_reaches_recall_on_vectors_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(nn, "LIST_SIZE", 10)
    v = np.random.default_rng(9).normal(size=(8000, 64))
    _, recall = searched_and_recall(spark, v / np.linalg.norm(v, axis=1)[:, None])
    assert recall >= 0.9, recall


def test_searched_share_of_clustered_vectors_falls_with_size(spark, monkeypatch):
    monkeypatch.setattr(nn, "LIST_SIZE", 20)
    random = np.random.default_rng(9)
    shares = []
    for clusters in (40, 200):
        means = random.normal(size=(clusters, 32))
        v = means[random.integers(0, clusters, clusters * 50)] + 0.2 * random.normal(size=(clusters * 50, 32))
        share, recall = searched_and_recall(spark, v)
        assert recall >= 0.9, recall
        shares.append(share)
    assert shares[0] < 0.5 and shares[1] < 0.5 * shares[0], shares


def test_queries_of_a_hot_list_are_dealt(spark, monkeypatch):
    """Many queries of one list meet each share of it once."""
    monkeypatch.setattr(nn, "SHARE", 30)
    rows = [(i, [1.0, float(i % 7)]) for i in range(200)]
    vectors = nn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nn.search(vectors, F.lit(True), 3).collect()
    ids, v = np.arange(200), np.array([x for _, x in rows])
    want = {(q, r, i, d) for q, best in brute(ids, v, range(200), 3).items() for r, (i, d) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == 600


def test_walk_meets_as_many_lists_as_are_wanted():
    random = np.random.default_rng(4)
    centroids, query = random.normal(size=(3000, 64)), random.normal(size=64)
    nodes, _ = nn.CentroidGraph(centroids).nearest(query, 750)
    best = np.argsort(((centroids - query) ** 2).sum(1))[:750]
    assert len(set(nodes[:750].tolist()) & set(best.tolist())) >= 740
