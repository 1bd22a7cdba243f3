"""Token functions, vocabulary, co-occurrence and weighting on hand-made and random input."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from semaspan.functions import tokens as tk
from semaspan.operators import cooccurrence, vocabulary
from semaspan.operators.cooccurrence import assemble_vectors, cooccurrences, vector_sum
from semaspan.operators.sentences import all_known, anonymise_corpus, longer_than, tokenised, unique_tokens
from semaspan.operators.vectors import pair_measures, sparse_vectors, subset_dimensions, to_long, to_nested
from semaspan.operators.vocabulary import fold_numerals, ranked_frequencies, select_basis, target_words, token_frequencies
from semaspan.operators.weighting import marginals, ppmi


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_line_tokens(spark):
    got = values(spark, tk.line_tokens(F.col("x")), [("a_B c_D ",), ("a  b",), ("",)], "x string")
    assert got == [["a_B", "c_D"], ["a", "", "b"], [""]]


def test_repair_anonymised(spark):
    rows = [(["a", "--", "AnonName_X", "b"],), (["--", "b"],), (["a", "--"],), (["a"],), (["--", "anon", "--", "anon"],)]
    got = values(spark, tk.repair_anonymised(F.col("x")), rows, "x array<string>")
    assert got == [["a", "--anonname_x", "b"], ["--", "b"], ["a", "--"], ["a"], ["--anon", "--", "anon"]]


def test_short_tags(spark):
    rows = [("run_VERB",), ("old_ADJ",), ("x_PRON",), ("a_b_SUBST",), ("plain",)]
    assert values(spark, tk.with_short_tag(F.col("x")), rows, "x string") == ["run_VB", "old_JJ", None, None, None]


def test_group_names(spark):
    df = spark.createDataFrame([("give_VERB_kiss_SUBST",), ("kiss_VERB",)], "x string")
    got = df.select(tk.group_head(F.col("x")), tk.group_tail(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("give_VERB", "kiss_SUBST"), ("kiss_VERB", "")]


def test_counted_tokens_need_white_space_after_them(spark):
    assert values(spark, tk.counted_tokens(F.col("x")), [("a_B  c_D e",)], "x string") == [["a_B", "c_D"]]


def test_anonymise_corpus_uses_the_lexicon_of_the_own_file(spark):
    sentences = spark.createDataFrame(
        [("f1", 0, ["two_ADJ", "4th_ADJ", "a_b_C"]), ("f2", 0, ["two_ADJ", "x_Y"]), ("f2", 1, [])], "file string, line_no long, ws array<string>"
    )
    lexicon = spark.createDataFrame([("f1", "two")], "file string, lemma string")
    got = {(r.file, r.line_no): r.ws for r in anonymise_corpus(sentences, lexicon, "file", ["file", "line_no"]).collect()}
    assert got == {
        ("f1", 0): ["--anonnumeral_ADJ", "--anonnumeral_ADJ", "a_b_C"], ("f2", 0): ["two_ADJ", "x_Y"], ("f2", 1): [],
    }


def test_all_known(spark):
    sentences = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zz"]), (3, ["--anonnumeral_ADJ"]), (4, [])], "id long, ws array<string>")
    words = spark.createDataFrame([("a",), ("b",)], "lemma_pos string")
    assert sorted(r.id for r in all_known(sentences, words, ["id"]).collect()) == [1, 3, 4]


def test_unique_tokens(spark):
    lines = spark.createDataFrame([("a,b c",), ("b ",)], "value string")
    assert sorted(r.token for r in unique_tokens(lines).collect()) == ["a", "b", "c"]


def test_fold_numerals(spark):
    rows = [("12_ADJ", 3), ("two_ADJ", 4), ("--anonnumeral_ADJ", 2), ("one_PRON", 9), ("_PUNC", 5), ("two_2_X", 1), ("cat_SUBST", 8)]
    freqs = spark.createDataFrame(rows, "lemma_pos string, freq long")
    lexicon = spark.createDataFrame([("two",), ("one",)], "lemma string")
    got = [(r["rank"], r.freq, r.lemma_pos) for r in fold_numerals(freqs, lexicon).orderBy("rank").collect()]
    assert got == [
        (1, 9, "one_PRON"), (2, 9, "--anonnumeral_ADJ"), (3, 8, "cat_SUBST"), (4, 5, "_PUNC"), (5, 1, "two_2_X"),
    ]


def test_basis_and_targets(spark):
    rows = [("the_ART", 90), ("on_PREP", 80), ("x_SUBST", 70), ("été_SUBST", 65), ("cat_SUBST", 60), ("dog_SUBST", 60), ("--anonnumeral_ADJ", 50), ("rare_ADJ", 1)]
    freqs = spark.createDataFrame(rows, "lemma_pos string, freq long")
    basis = [(r.basis_index, r.lemma_pos) for r in select_basis(freqs, 3, 1).orderBy("basis_index").collect()]
    assert basis == [(0, "dog_SUBST"), (1, "cat_SUBST"), (2, "--anonnumeral_ADJ")]
    targets = [(r.voc_index, r.lemma_pos) for r in target_words(freqs, 60, 5).orderBy("voc_index").collect()]
    assert targets == [(0, "the_ART"), (1, "on_PREP"), (2, "x_SUBST"), (3, "été_SUBST"), (4, "dog_SUBST")]
    # the sorted plan for large vocabularies agrees with the heap plan for small ones
    assert target_words(freqs, 60, 50_000).filter("voc_index < 5").count() == 5


def test_frequencies_and_ranks(spark):
    lines = spark.createDataFrame([("b_X a_X b_X ",), ("c_X a_X ",)], "value string")
    ranked = ranked_frequencies(token_frequencies(lines)).orderBy("rank").collect()
    assert [(r["rank"], r.freq, r.lemma_pos) for r in ranked] == [(1, 2, "b_X"), (2, 2, "a_X"), (3, 1, "c_X")]


def brute_force(sentences, targets, basis, window, min_length):
    counts = Counter()
    for s in sentences:
        if len(s) <= min_length:
            continue
        for i, w in enumerate(s):
            for j, c in enumerate(s):
                if w in targets and c in basis and w != c and abs(i - j) <= window:
                    counts[(w, basis[c])] += 1
    return counts


@pytest.mark.parametrize("window", [1, 3, 5])
@pytest.mark.parametrize("bounded", [True, False])
def test_cooccurrence_against_brute_force(spark, window, bounded):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(12)]
    # w0 is hot, sentences are shorter and longer than the window
    sentences = [[rng.choice(words) if rng.random() < 0.6 else "w0" for _ in range(rng.randrange(0, 25))] for _ in range(60)]
    targets, basis = {w: i for i, w in enumerate(words[:8])}, {w: i for i, w in enumerate(words[3:] + ["w0"])}
    df = spark.createDataFrame([(s,) for s in sentences], "ws array<string>")
    t = spark.createDataFrame([(i, w) for w, i in targets.items()], "voc_index int, lemma_pos string")
    b = spark.createDataFrame([(i, w) for w, i in basis.items()], "basis_index int, lemma_pos string")
    bounds = {} if bounded else {"max_targets": None, "max_basis": None}
    cells = cooccurrences(df, t, b, window, 4, **bounds)
    got = {(r.lemma_pos, r.basis_index): r.n for r in cells.collect()}
    assert got == brute_force(sentences, targets, basis, window, 4)


def test_same_vocabulary_and_basis_give_a_symmetric_space(spark):
    rng = random.Random(1)
    words = ["a", "b", "c", "d"]
    df = spark.createDataFrame([([rng.choice(words) for _ in range(9)],) for _ in range(20)], "ws array<string>")
    t = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "voc_index int, lemma_pos string")
    b = t.withColumnRenamed("voc_index", "basis_index")
    got = {(r.lemma_pos, words[r.basis_index]): r.n for r in cooccurrences(df, t, b, 2, 0).collect()}
    assert all(n == got[(c, w)] for (w, c), n in got.items())


def test_minimum_length_is_strict(spark):
    df = tokenised(spark.createDataFrame([("a b c d e ",), ("a b c d e f ",)], "value string"))
    assert longer_than(df, 5).count() == 1


def test_ppmi_against_its_definition(spark):
    counts = {("a", 0): 4, ("a", 1): 1, ("b", 0): 1, ("b", 2): 7, ("c", 1): 2}
    cells = spark.createDataFrame([(w, c, n) for (w, c), n in counts.items()], "lemma_pos string, basis_index int, n long")
    row, col, total = Counter(), Counter(), sum(counts.values())
    for (w, c), n in counts.items():
        row[w] += n
        col[c] += n
    want = {k: math.log2((n / total) / (row[k[0]] / total * col[k[1]] / total)) for k, n in counts.items()}
    want = {k: v for k, v in want.items() if v > 0}
    got = {(r.lemma_pos, r.basis_index): r.ppmi for r in ppmi(cells).collect()}
    assert got == pytest.approx(want)
    totals = {(r.lemma_pos, r.basis_index): r.total for r in marginals(cells).collect()}
    assert totals[(None, None)] == total and totals[("b", None)] == 8 and totals[(None, 1)] == 3


def test_words_without_context_keep_an_empty_vector(spark):
    cells = spark.createDataFrame([("a", 3, 2), ("a", 1, 5)], "lemma_pos string, basis_index int, n long")
    targets = spark.createDataFrame([(0, "a"), (1, "b")], "voc_index int, lemma_pos string")
    got = {r.lemma_pos: [tuple(p) for p in r.vector] for r in assemble_vectors(cells, targets).collect()}
    assert got == {"a": [(1, 5), (3, 2)], "b": []}
    assert to_long(assemble_vectors(cells, targets), "vector", "n").count() == 2
    assert {(r.basis_index, r.n) for r in vector_sum(cells.unionByName(cells)).collect()} == {(3, 4), (1, 10)}


def test_vector_forms_and_dimension_subset(spark):
    cells = spark.createDataFrame([("a", 3, 2.5), ("a", 1, 5.0), ("b", 2, 1.0)], "lemma_pos string, basis_index int, x double")
    nested = to_nested(cells, "x")
    assert {r.lemma_pos: r.x for r in nested.collect()} == {"a": [[1.0, 5.0], [3.0, 2.5]], "b": [[2.0, 1.0]]}
    assert sorted(map(tuple, to_long(nested, "x", "x").collect())) == sorted(map(tuple, cells.collect()))
    dims = spark.createDataFrame([(3, 0), (2, 1), (3, 2)], "basis_index int, new_index int")
    got = sorted(map(tuple, subset_dimensions(cells, dims).collect()))
    assert got == [("a", 0, 2.5), ("a", 2, 2.5), ("b", 1, 1.0)]


def test_pair_measures_with_missing_cells(spark):
    cells = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 4.0), ("b", 1, 2.0), ("b", 2, 1.0)], "lemma_pos string, basis_index int, ppmi double")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", "empty"), (4, "empty", "void")], "id int, word1 string, word2 string")
    got = {r.id: (r.dot, r.cosine, r.euclidean) for r in pair_measures(pairs, cells, ["id"]).collect()}
    assert got[1] == pytest.approx((8.0, 8 / (5 * math.sqrt(5)), math.sqrt(9 + 4 + 1)))
    assert got[2] == pytest.approx((25.0, 1.0, 0.0))
    assert got[3] == pytest.approx((0.0, 0.0, 5.0))
    assert got[4] == pytest.approx((0.0, 0.0, 0.0))


def test_pair_measures_against_dense_vectors(spark):
    rng = random.Random(3)
    # repeated cells add up, null cells say nothing, no cell of a word beyond the pairs is packed
    cells = [(w, i, rng.choice([None, 0.0, rng.uniform(-3, 3)])) for w in "abcdef" for i in rng.choices(range(40), k=rng.choice([0, 3, 30]))]
    pairs = [(x, y) for x in "abcdez" for y in "abcdez"]
    dense = {w: [sum(x or 0.0 for v, i, x in cells if v == w and i == d) for d in range(40)] for w in "abcdefz"}
    frame = spark.createDataFrame(cells, "lemma_pos string, basis_index int, ppmi double")
    got = pair_measures(spark.createDataFrame(pairs, "word1 string, word2 string"), frame, ()).collect()
    assert len(got) == len(pairs)
    for r in got:
        a, b = dense[r.word1], dense[r.word2]
        dot, size = sum(x * y for x, y in zip(a, b)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
        assert r.dot == pytest.approx(dot, abs=1e-12) and r.euclidean == pytest.approx(math.dist(a, b), abs=1e-12)
        assert r.cosine == pytest.approx(dot / size if size else 0.0, abs=1e-12)
    assert pair_measures(spark.createDataFrame([], "word1 string, word2 string"), frame, ()).count() == 0


def test_pairs_move_no_cells(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "lemma_pos string, basis_index int, ppmi double")
    pairs = spark.createDataFrame([("a", "b")], "word1 string, word2 string")
    plan = pair_measures(pairs, cells, ())._jdf.queryExecution().optimizedPlan().toString()
    # no row is grouped by pair and dimension: cells are grouped by word alone
    assert re.search(r"Aggregate \[lemma_pos#\d+, basis_index", plan) and not re.search(r"Aggregate \[word1#[^]]*basis_index", plan), plan


def test_sparse_vectors_hold_one_row_a_word(spark):
    cells = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("a", 3, 4.0), ("a", 2, None), ("b", 9, None)], "lemma_pos string, basis_index int, ppmi double")
    assert [tuple(r) for r in sparse_vectors(cells).collect()] == [("a", [1, 3], [2.0, 5.0], 29.0)]


def test_bounded_vocabularies_are_counted_in_the_task(spark):
    rows = [("de", ["a", "b", "a", None, "c"]), (None, ["a", "b", "c"]), ("de", None), ("de", []), (None, ["b"])]
    df = spark.createDataFrame(rows, "lang string, ws array<string>")
    t = spark.createDataFrame([(7, "a"), (5, "c")], "voc_index int, lemma_pos string")
    b = spark.createDataFrame([(0, "b"), (3, "a"), (1, None)], "basis_index int, lemma_pos string")
    cells = cooccurrences(df, t, b, 2, 2, keys=["lang"])
    want = {("de", "a", 0): 2, ("de", "c", 3): 1, (None, "a", 0): 1, (None, "c", 0): 1, (None, "c", 3): 1}
    assert {(r.lang, r.lemma_pos, r.basis_index): r.n for r in cells.collect()} == want
    # no row a token or a pair: tokens leave the task as folded cells alone
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    # a word that is listed twice keeps both its numbers
    twice = t.unionByName(spark.createDataFrame([(9, "a")], "voc_index int, lemma_pos string"))
    assert cooccurrences(df, twice, b, 2, 2).filter("lemma_pos = 'a'").agg({"n": "sum"}).first()[0] == 6
    with pytest.raises(Exception, match="at most 1 rows was promised"):
        cooccurrences(df, t, b, 2, 2, max_targets=1).collect()


def test_tasks_give_their_cells_in_parts(monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    sentences = [[rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(300)]
    targets, basis = {w: i for i, w in enumerate(words[:20])}, {w: i for i, w in enumerate(words[10:])}
    t = pa.table({"lemma_pos": list(targets), "voc_index": pa.array(targets.values(), pa.int32())})
    b = pa.table({"lemma_pos": list(basis), "basis_index": pa.array(basis.values(), pa.int32())})
    batch = pa.RecordBatch.from_arrays([pa.array([i % 3 for i in range(300)]), pa.array(sentences)], ["k", "ws"])
    want = Counter()
    for k in range(3):
        want.update({(k, targets[w], d): n for (w, d), n in brute_force(sentences[k::3], targets, basis, 4, 5).items()})
    for held in (60, 700, 1 << 20):
        monkeypatch.setattr(cooccurrence, "HELD", held)
        got = Counter()
        for part in cooccurrence.task_cells(iter([batch.slice(0, 130), batch.slice(130)]), t, b, 4, 5):
            for r in part.to_pylist():
                got[(r["k"], r["voc_index"], r["basis_index"])] += r["n"]
        assert got == want


def test_tokens_are_counted_where_they_are_made(spark, monkeypatch):
    rows = [("a b a c",), (None,), ("b a c",), ("c",)]
    lines = spark.createDataFrame(rows, "line string").repartition(3)
    freqs = token_frequencies(lines, "line", tokenise=lambda x: pc.split_pattern(x, " "))
    assert {r.lemma_pos: r.freq for r in freqs.collect()} == {"a": 3, "b": 2, "c": 3}
    t = spark.createDataFrame([(0, "a"), (1, "c")], "voc_index int, lemma_pos string")
    b = spark.createDataFrame([(0, "b"), (1, "a")], "basis_index int, lemma_pos string")
    plans = []
    for bounds in ({}, {"max_targets": None, "max_basis": None}):
        cells = cooccurrences(lines, t, b, 2, 2, "line", tokenise=lambda x: pc.split_pattern(x, " "), **bounds)
        assert {(r.lemma_pos, r.basis_index): r.n for r in cells.collect()} == {("a", 0): 3, ("c", 1): 2, ("c", 0): 2}
        plans.append(cells._jdf.queryExecution().optimizedPlan().toString())
    plans.append(freqs._jdf.queryExecution().optimizedPlan().toString())
    assert ["Generate" in p for p in plans] == [False, True, False]
    # few different tokens are held at once, and no count is lost when a part is given out
    lists = [pa.array([[f"w{i * j % 41}" for j in range(i)], None, [None]], pa.list_(pa.string())) for i in range(60)]
    want = Counter(w for x in lists for ws in x.to_pylist() for w in ws or [])
    for held in (5, 60, 10_000):
        monkeypatch.setattr(vocabulary, "HELD", held)
        got = Counter()
        for part in vocabulary.task_counts(iter(lists)):
            for r in part.to_pylist():
                got[r["lemma_pos"]] += r["n"]
        assert got == want
