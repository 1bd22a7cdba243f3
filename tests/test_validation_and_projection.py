"""Rank correlation, coverage, scales and projections."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semaspan.functions import dense
from semaspan.operators import projection as proj
from semaspan.operators import validation as val
from semaspan.operators.vectors import norms
from semaspan.workload import views
from semaspan.workload.queries import QUERIES

CELLS = [("s1", 0, 2.0), ("s1", 1, 1.0), ("s2", 0, 4.0), ("l1", 2, 3.0), ("w", 0, 1.0), ("w", 2, 2.0), ("v", 1, 5.0)]


@pytest.fixture
def space(spark):
    cells = spark.createDataFrame(CELLS, "lemma_pos string, basis_index int, ppmi double")
    seeds = spark.createDataFrame([("s1", 1), ("s2", 1), ("l1", 2)], "lemma_pos string, category int")
    words = spark.createDataFrame([(w,) for w in ("s1", "s2", "l1", "w", "v", "empty")], "lemma_pos string")
    return cells, seeds, words


def vector(word):
    out = np.zeros(3)
    for w, i, x in CELLS:
        if w == word:
            out[i] = x
    return out


SCALE = (vector("s1") + vector("s2")) / 2 - vector("l1")


def expected(v):
    return float(v @ SCALE / np.linalg.norm(SCALE))


# published correlations of word similarity tasks: (rho, pairs, two-sided p)
PUBLISHED = [
    (0.6182262322066308, 27, 0.0005887562544347321), (-0.4713784210010064, 27, 0.013064643568457115),
    (0.5315219112453058, 27, 0.0043290406652196295), (0.3626373626373627, 13, 0.22331572029248162),
    (-0.4175824175824176, 13, 0.1556747536334745), (0.20329670329670327, 13, 0.5053147342962486),
]


def test_p_of_published_correlations(spark):
    df = spark.createDataFrame([(r, n) for r, n, _ in PUBLISHED], "rho double, n long")
    got = {r.rho: r.p_value for r in val.with_spearman_p(df).collect()}
    assert all(got[r] == pytest.approx(p, rel=1e-10) for r, _, p in PUBLISHED)


def test_spearman_with_ties(spark, many_slices):
    human = [1.0, 2.0, 2.0, 4.0, 5.0, 5.0, 7.0]
    model = [0.1, 0.4, 0.3, 0.3, 0.9, -0.0, 0.0]
    df = spark.createDataFrame(list(zip(human, model)), "human double, cosine double")

    def ranks(x):
        x = np.array(x) + 0.0
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    got = val.spearman(df, ["cosine"]).first()
    assert got.n == 7 and got.rho == pytest.approx(np.corrcoef(ranks(human), ranks(model))[0, 1])


def test_rating_forms(spark):
    df = spark.createDataFrame([("Old", "New", "A", 1.0), ("Go", "Come", "V", 2.0), ("Cat", "Dog", "N", 3.0)], "word1 string, word2 string, pos string, human double")
    assert [r.word1 for r in val.normalise_ratings(df, "pos-column").collect()] == ["old_ADJ", "go_VERB", "cat_SUBST"]
    assert [r.word2 for r in val.normalise_ratings(df, "VB").collect()] == ["new_VERB", "come_VERB", "dog_VERB"]
    marked = spark.createDataFrame([("Sun-n", "hot-j", 1.0), ("run-v", "x-n", 2.0)], "word1 string, word2 string, human double")
    got = [(r.word1, r.word2) for r in val.normalise_ratings(marked, "suffix").collect()]
    assert got == [("sun_SUBST", "hot_ADJ"), ("run_VERB", "x_SUBST")]


def test_pair_scores_and_coverage(spark, space):
    cells, _, words = space
    ratings = spark.createDataFrame([("s1", "w", 1.0), ("s1", "nope", 2.0), ("nope", "none", 3.0)], "word1 string, word2 string, human double")
    scored = val.pair_scores(ratings, cells, words).collect()
    assert len(scored) == 1 and scored[0].dot == pytest.approx(2.0)
    row = val.coverage(ratings, words).first()
    assert (row.pairs, row.pairs_scored, row.percent_scored, row.words_missing) == (3, 1, 33.33, 2)
    assert sorted(r.lemma_pos for r in val.missing_rating_words(ratings, words).collect()) == ["none", "nope"]


def test_scale_and_word_projections(spark, space):
    cells, seeds, words = space
    means = {(r.category, r.basis_index): r["mean"] for r in proj.category_means(seeds, cells).collect()}
    assert means == {(1, 0): 3.0, (1, 1): 0.5, (2, 2): 3.0}
    scale = proj.scale_vector(seeds, cells)
    assert {r.basis_index: r.weight for r in scale.collect()} == pytest.approx(dict(enumerate(SCALE)))
    turned = {r.basis_index: r.weight for r in proj.scale_vector(seeds, cells, 2).collect()}
    assert turned == pytest.approx(dict(enumerate(-SCALE)))
    got = {r.lemma_pos: r.projection for r in proj.word_projections(words, cells, scale).collect()}
    assert got == pytest.approx({w: expected(vector(w)) for w in ("s1", "s2", "l1", "w", "v", "empty")})
    ends = {r.category: r.projection for r in proj.scale_endpoints(proj.category_means(seeds, cells), scale).collect()}
    assert ends == pytest.approx({1: expected((vector("s1") + vector("s2")) / 2), 2: expected(vector("l1"))})
    assert {r.lemma_pos: r.norm for r in norms(cells).collect()}["s1"] == pytest.approx(5**0.5)


def test_pairs_add_the_projections_of_their_parts(spark, space):
    cells, seeds, words = space
    projections = proj.word_projections(words, cells, proj.scale_vector(seeds, cells))
    pairs = spark.createDataFrame([("s1", "w", "v"), ("s1", "nope", "v"), ("s1", "w", "s1"), ("nope", "nope", "nil")], "lv_pos string, nominal_pos string, fvc_pos string")
    got = {(r.fvc, r.lv, r.lv_noun): (r.fvc_projection, r.lvc_projection) for r in proj.pair_projections(pairs, projections).collect()}
    assert set(got) == {("v", "s1", "w"), ("s1", "s1", "w")}
    assert got[("v", "s1", "w")] == pytest.approx((expected(vector("v")), expected(vector("s1") + vector("w"))))
    assert [r.fvc for r in proj.pair_projections(pairs, projections, "compat").collect()] == ["v"]
    missing = sorted(r.lemma_pos for r in proj.missing_pair_words(pairs, words).collect())
    assert missing == ["nil", "nope", "nope"]
    listed = spark.createDataFrame([("w",), ("nope",)], "lemma_pos string")
    assert {r.lemma_pos: r.found for r in proj.project_word_list(listed, projections).collect()} == {"w": True, "nope": False}


def test_sentences(spark, space):
    cells, seeds, words = space
    sentences = spark.createDataFrame(
        [(1, ["w", "v", "w"]), (2, ["w", "nope"]), (3, []), (4, ["empty"]), (5, ["empty", "s1"])], "id long, ws array<string>"
    )
    want = {1: 2 * vector("w") + vector("v"), 3: np.zeros(3), 4: np.zeros(3), 5: vector("s1")}
    scale = proj.scale_vector(seeds, cells)
    projections = proj.word_projections(words, cells, scale)
    got = {r.id: r.projection for r in proj.sentence_projections(sentences, projections, ["id"]).collect()}
    assert got == pytest.approx({i: expected(v) for i, v in want.items()})
    vectors = {i: np.zeros(3) for i in want}
    rows = proj.sentence_vectors(sentences, cells, words, ["id"]).collect()
    assert {r.id for r in rows} == set(want)
    for r in rows:
        if r.basis_index is not None:
            vectors[r.id][r.basis_index] += r.ppmi
    assert all(np.allclose(vectors[i], want[i]) for i in want)


def test_sentence_vectors_move_no_cell_of_a_sentence(spark, space):
    cells, _, words = space
    sentences = spark.createDataFrame([(1, ["s1", "w", "w"]), (2, [])], "id int, ws array<string>")
    plan = proj.sentence_vectors(sentences, cells, words, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "basis_index" in line]
    assert "Exchange" not in plan.split("MapInArrow")[0]


def test_sums_of_a_block_do_not_depend_on_its_chunks(monkeypatch):
    monkeypatch.setattr(proj, "CELLS_AT_ONCE", 20)
    rng = np.random.default_rng(3)
    vectors = {w: {int(d): float(rng.normal()) for d in rng.choice(9, 4, replace=False)} for w in range(0, 30, 3)}
    texts = [[int(w) for w in rng.integers(0, 30, n)] for n in (0, 5, 40, 1, 0, 7, 3)] + [[1]]
    types = {"id": pa.int64(), "_block": pa.int32(), "_words": pa.list_(pa.int64()), "indices": pa.list_(pa.int32()), "values": pa.list_(pa.float64())}
    rows = [(None, 0, [w], list(v), list(v.values())) for w, v in vectors.items()] + [(i, 0, t, None, None) for i, t in enumerate(texts)]
    # a second block does not see the vectors of the first
    rows.append((99, 1, [0, 3], None, None))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))
    got = {}
    for out in proj._block_sums(["id"])(iter([batch.slice(0, 4), batch.slice(4, 9), batch.slice(13)])):
        got |= {r["id"]: dict(zip(r["indices"], r["values"])) for r in out.to_pylist()}
    want = {99: {None: 0.0}}
    for i, text in enumerate(texts):
        want[i] = {}
        for w in text:
            for d, x in vectors.get(w, {}).items():
                want[i][d] = want[i].get(d, 0.0) + x
        want[i] = want[i] or {None: 0.0}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_principal_components(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(30, 4)) * [3, 2, 1, 0.5] + 7
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id int, features array<double>")
    got = np.array([[r.pc1, r.pc2] for r in proj.pca_2d(df, "id").orderBy("id").collect()])
    centred = data - data.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = [a * np.sign(a[np.argmax(np.abs(a))]) for a in axes[:2]]
    assert np.allclose(got, centred @ np.array(axes).T)


def test_sparse_words_become_dense_vectors(spark, space):
    cells, _, words = space
    got = {r.lemma_pos: r.features for r in proj.dense_vectors(cells, words, 3).collect()}
    assert got == {w: list(vector(w)) for w in ("s1", "s2", "l1", "w", "v", "empty")}


def test_dense_measures(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(dense.dot(a, b), dense.cosine(a, b), dense.euclidean(a, b)).collect()
    assert tuple(rows[0]) == pytest.approx((24.0, 0.96, 2**0.5)) and tuple(rows[1]) == pytest.approx((0.0, 0.0, 2**0.5))


def test_sentences_are_scored_where_they_are_read(spark):
    projections = spark.createDataFrame([("w", 2.0), ("v", 0.5), ("gap", None), (None, 9.0)], "lemma_pos string, projection double")
    rows = [(1, ["w", "v", "w"]), (2, ["w", "nope"]), (3, []), (4, None), (5, ["w", None]), (6, ["gap"]), (7, ["w"]), (7, ["v"]), (8, ["v"]), (8, ["nope"]), (None, ["v"])]
    sentences = spark.createDataFrame(rows, "id long, ws array<string>").repartition(3)
    want = {1: 4.5, 3: 0.0, 4: 0.0, 5: 2.0, 7: 2.5, None: 0.5}
    for bound in (None, 4):
        scored = proj.sentence_projections(sentences, projections, ["id"], max_words=bound)
        assert {r.id: r.projection for r in scored.collect()} == want
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # tokens become no rows
    lines = spark.createDataFrame([(1, "w v w"), (2, "nope"), (3, "")], "id long, line string")

    def placed(texts):
        made = pa.array([t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
        flat = made.flatten().dictionary_encode()
        return pa.ListArray.from_arrays(made.offsets, flat)

    for bound in (None, 4):
        scored = proj.sentence_projections(lines, projections, ["id"], "line", bound, placed)
        assert {r.id: r.projection for r in scored.collect()} == {1: 4.5, 3: 0.0}
    with pytest.raises(Exception, match="promised"):
        proj.sentence_projections(sentences, projections, ["id"], max_words=3).collect()


def test_no_sentence_of_a_group_moves(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(views, "stored", lambda df, keep=views.stored: stored.append(df.columns) or keep(df))
    found = QUERIES["group_projection"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert stored and all("ws" not in columns for columns in stored) and "ws#" not in plan and "SortAggregate" not in plan
    keys = [r[:4] for r in found.collect()]
    assert len(keys) == len(set(keys)) > 0
