import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semaspan.llm import hard_negatives as hn


def want(rows, is_anchor):
    """All pairs, with Python's integers. rows: {vec_id: (label, whole components)}."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in filter(is_anchor, rows):
        score = {b: dot(rows[a][1], rows[b][1]) for b in rows if b != a}
        best = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in best if rows[b][0] == rows[a][0]][:5]:
            inside = [b for b in best if rows[b][0] != rows[a][0] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out |= {(a, p, rank, b, score[p], score[b]) for rank, b in enumerate(inside[:10], 1)}
    return out


def mined(df, is_anchor):
    return {tuple(r) for r in hn.hard_negatives(df, is_anchor).collect()}


@pytest.mark.parametrize("kind", ["clusters", "uniform", "equal"])
def test_against_all_pairs_over_many_blocks_and_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "BLOCK", 12)
    monkeypatch.setattr(hn, "CHUNK", 150)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 2
    v = {"clusters": lambda n: centres[n % 6] + rng.normal(size=8) * 0.3, "uniform": lambda n: rng.normal(size=8), "equal": lambda n: centres[n % 2]}[kind]
    rows = [(n, [float(np.float32(x)) for x in v(n)], int(rng.integers(0, 4))) for n in range(600)]
    df = hn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    whole = {n: (label, [int(np.floor(256 * x)) for x in e]) for n, e, label in rows}
    got = mined(df, F.col("vec_id") % 10 == 0)
    assert got == want(whole, lambda n: n % 10 == 0) and len(got) > 100


def test_bounds_leave_most_rows_of_clusters_unscored():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 400
    v = np.floor(centres[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 16)) * 8).astype(np.int64)
    label = rng.integers(0, 5, 4_000)
    rows = pa.table({"vec_id": np.arange(4_000), "label": label, "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    anchors = np.arange(0, 4_000, 10)
    parent, edge = hn.spanning_tree(v[anchors])
    scores = hn.Scores(hn.Chunk.of(rows), v[anchors], parent, edge)
    found = {i: (at, s) for i, at, s in hn.best_positives(scores, anchors, label[anchors])}
    assert scores.scored < 0.2 * len(anchors) * len(v)
    for i, a in enumerate(anchors):
        exact = v @ v[a]
        same = [n for n in np.argsort(-exact, kind="stable") if label[n] == label[a] and n != a][:5]
        assert found[i][0].tolist() == same and found[i][1].tolist() == exact[same].tolist()


def test_tree_is_minimal_and_walked_with_few_open_parents():
    rng = np.random.default_rng(2)
    points = rng.integers(-50, 50, (60, 3))
    parent, edge = hn.spanning_tree(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    joined, total = {0}, 0.0
    while len(joined) < 60:  # the plain rule
        d, j = min((far[i, j], j) for i in joined for j in range(60) if j not in joined)
        joined.add(j)
        total += d
    assert np.isclose(edge.sum(), total) and np.allclose(edge[1:], far[np.arange(1, 60), parent[1:]])
    met, open_, most = set(), {}, 0
    left = np.bincount(parent[1:], minlength=60)
    for i, up in hn.walk(parent):
        assert up in met or up == -1
        met.add(i)
        if left[i]:
            open_[i] = left[i]
        most = max(most, len(open_))
        if up >= 0:
            open_[up] -= 1
            if not open_[up]:
                del open_[up]
    assert len(met) == 60 and most <= 8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1, "x"), (0, [1.0, 1.0], 1, "x"), (1, [1.0, 0.9], 1, "y"), (2, [0.5, 0.5], 2, None), (3, [0.6], 2, None),
        (4, [], 3, None), (5, None, 1, None), (6, [nan, 1.0], 1, None), (7, [inf, 1.0], 2, None), (8, [None, 1.0], 2, None),
        (9, [1.0, 1.0], None, None), (None, [1.0, 1.0], 2, None), (100, [-1.0, -1.0], 2, None), (200, [-1.0, -1.0], 3, None), (300, [1e300, 1.0], 7, None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, positive_id string")
    used = hn.usable(df)
    assert sorted(r.vec_id for r in used.collect()) == [0, 1, 2, 3, 4, 100, 200, 300]
    got = mined(used.filter("vec_id < 300"), F.col("vec_id") % 100 == 0)
    whole = {0: (1, [256, 256]), 1: (1, [256, 230]), 2: (2, [128, 128]), 3: (2, [153, 0]), 4: (3, [0, 0]), 100: (2, [-256, -256]), 200: (3, [-256, -256])}
    assert got == want(whole, lambda n: n % 100 == 0)
    assert {r[0] for r in mined(used, F.col("vec_id") % 100 == 0)} >= {0}  # with components that doubles cannot multiply exactly
    assert mined(used.limit(0), F.col("vec_id") % 100 == 0) == set()
    assert mined(used, F.lit(False)) == set()
