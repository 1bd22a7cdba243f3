"""Constructions, groups, summaries and tests against hand-made input and published values."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaspan.functions.distributions import normal_quantile, normal_upper, t_quantile, t_two_sided, t_upper
from semaspan.operators import constructions as cons
from semaspan.operators import hypothesis as hyp
from semaspan.operators import summaries as summ

PAIRS = [("give_VERB", "kiss_SUBST", "kiss_VERB"), ("give_VERB", "hug_SUBST", "hug_VERB"), ("take_VERB", "walk_SUBST", "walk_VERB")]
TOKENS = [  # (line, id, lemma, upos, deprel, head)
    (0, 1, "she", "PRON", "nsubj", 2), (0, 2, "give", "VERB", "root", 0), (0, 3, "kiss", "NOUN", "obj", 2), (0, 4, "two", "NUM", "nummod", 3),
    (1, 1, "take", "VERB", "root", 0), (1, 2, "kiss", "NOUN", "obj", 1), (1, 3, "kiss", "VERB", "conj", 1), (1, 4, "kiss", "VERB", "conj", 1),
    (2, 1, "give", "VERB", "root", 0), (2, 2, "kiss", "NOUN", "nsubj", 1), (2, 3, "kiss", "NOUN", "obj", 9),
]


@pytest.fixture
def annotated(spark):
    return spark.createDataFrame([("f", *t) for t in TOKENS], "file string, line_no long, id long, lemma string, upos string, deprel string, head long")


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "lv_pos string, nominal_pos string, fvc_pos string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_matches(annotated, pairs):
    objects = cons.object_constructions(annotated, pairs)
    assert rows(objects, "line_no", "id", "lv", "nominal") == [(0, 3, "give_VERB", "kiss_SUBST")]
    verbs = cons.plain_verbs(annotated, pairs)
    assert rows(verbs, "line_no", "id", "fvc") == [(1, 3, "kiss_VERB"), (1, 4, "kiss_VERB")]
    assert rows(cons.numeral_lexicon(annotated), "file", "lemma") == [("f", "two")]
    groups = cons.candidate_groups(objects, verbs)
    assert rows(groups, "construction", "kind") == [("give_VERB_kiss_SUBST", "LVC"), ("kiss_VERB", "FVC"), ("kiss_VERB", "FVC")]
    assert rows(cons.corresponding_groups(groups, pairs), "lv_pos", "nominal_pos", "fvc_pos", "fvc_observed") == [("give_VERB", "kiss_SUBST", "kiss_VERB", True)]


def test_sentences_as_arrays_match_as_rows_do(spark, annotated, pairs):
    token = F.struct("id", "lemma", "upos", "deprel", "head")
    for order in (token["id"], -token["id"]):  # heads lie at their place, or are looked up by their id
        tokens = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("place"), token.alias("t")))), lambda x: x["t"])
        parsed = annotated.groupBy("file", "line_no").agg(tokens.alias("annotated"))
        objects = cons.parsed_objects(parsed, pairs)
        assert rows(objects, *objects.columns) == rows(cons.object_constructions(annotated, pairs), *objects.columns) != []
        verbs = cons.parsed_verbs(parsed, pairs)
        assert rows(verbs, *verbs.columns) == rows(cons.plain_verbs(annotated, pairs), *verbs.columns) != []
    nothing = parsed.withColumn("annotated", F.when(F.lit(False), F.col("annotated")))
    assert cons.parsed_objects(nothing, pairs).count() == cons.parsed_verbs(parsed.limit(0), pairs).count() == 0


def test_group_pairing(spark, pairs):
    groups = spark.createDataFrame([("give_VERB_kiss_SUBST",), ("give_VERB_hug_SUBST",), ("give_VERB_odd_SUBST",), ("kiss_VERB",), ("walk_VERB",)], "construction string")
    assert rows(cons.strict_pairs(groups, pairs), "fvc_pos", "lv_pos", "nominal_pos") == [("kiss_VERB", "give_VERB", "kiss_SUBST")]
    found = {r.nominal_pos: (r.fvc_pos, r.fvc_observed) for r in cons.corresponding_groups(groups, pairs).collect()}
    assert found == {"kiss_SUBST": ("kiss_VERB", True), "hug_SUBST": ("hug_VERB", False), "odd_SUBST": (None, False)}
    maps = rows(cons.pair_maps(pairs).filter("relation = 'noun_of_light_verb'"), "key", "member")
    assert maps == [("give", "hug"), ("give", "kiss"), ("take", "walk")]


def test_clean_groups(spark):
    groups = spark.createDataFrame([
        ("give_VERB_kiss_SUBST", "a_X give_VERB kiss_SUBST"), ("give_VERB_kiss_SUBST", "a_X give_VERB kiss_SUBST"),
        ("give_VERB_kiss_SUBST", "give_VERB a_X"), ("give_VERB", "forgive_VERB x_X"), ("give_VERB", "give_VERB x_X"),
    ], "construction string, sentence string")
    assert rows(cons.clean_groups(groups), "construction", "sentence") == [
        ("give_VERB", "give_VERB x_X"), ("give_VERB_kiss_SUBST", "a_X give_VERB kiss_SUBST"),
    ]
    assert cons.clean_groups(groups, mode="compat").filter("construction = 'give_VERB'").count() == 2


def test_unprocessed(spark):
    inputs, done = spark.createDataFrame([("a",), ("b",), ("a",)], "path string"), spark.createDataFrame([("b",)], "path string")
    assert rows(cons.unprocessed(inputs, done), "path") == [("a",)]


def test_length_summary(spark):
    rng = np.random.default_rng(2)
    data = [("kiss_VERB", "FVC", int(x)) for x in rng.integers(2, 30, 41)] + [("give_VERB_kiss_SUBST", "LVC", int(x)) for x in rng.integers(2, 90, 20)] + [("hug_VERB", "FVC", 4)]
    df = spark.createDataFrame(data, "construction string, kind string, length long")
    got = {(r.level, r.construction, r.kind): r for r in summ.length_summary(df).collect()}
    assert len(got) == 6
    for key, values in {
        ("construction", "kiss_VERB", "FVC"): [x for c, _, x in data if c == "kiss_VERB"],
        ("kind", None, "FVC"): [x for _, k, x in data if k == "FVC"],
        ("all", None, None): [x for _, _, x in data],
    }.items():
        r = got[key]
        want = (len(values), min(values), *np.quantile(values, [0.25, 0.5, 0.75]), np.mean(values), np.std(values, ddof=1), max(values))
        assert (r.n, r.min, r.q1, r.median, r.q3, r["mean"], r.sd, r.max) == pytest.approx(want)
    assert got[("construction", "hug_VERB", "FVC")].sd is None


def test_lengths_count_runs_of_white_space_once(spark):
    df = spark.createDataFrame([(" a  b\tc ",), ("",), ("   ",)], "sentence string")
    assert [r.length for r in summ.sentence_lengths(df).collect()] == [3, 0, 0]


SCORES = [("p", "FVC", float(x)) for x in (1, 2, 2, 3, 3, 4, 4, 5, 9, 40)] + [("p", "LVC", float(x)) for x in (2, 2, 3, 3)] + [("q", "FVC", 1.0), ("q", "LVC", 2.0), ("q", "LVC", 3.0)]


def test_outliers_and_notes(spark, many_slices):
    df = spark.createDataFrame(SCORES, "pair string, kind string, score double")
    flagged = {r.score: (r.is_outlier, r.is_extreme) for r in summ.flag_outliers(df, ["pair", "kind"], "score").filter("pair = 'p' AND kind = 'FVC'").collect()}
    assert flagged[40.0] == (True, True) and flagged[9.0] == (True, False) and flagged[4.0] == (False, False)
    sizes = {m: summ.remove_outliers(df, ["pair", "kind"], "score", m).count() for m in ("none", "extreme", "all")}
    assert sizes == {"none": 17, "extreme": 16, "all": 15}
    notes = {(m, r.pair): (r.note, r.fvc_n, r.lvc_n) for m in sizes for r in summ.pair_notes(df, m).collect()}
    assert notes[("none", "p")] == ("EXTREME OUTLIERS PRESENT", 10, 4)
    assert notes[("extreme", "p")] == ("EXTREME OUTLIERS REMOVED", 9, 4)
    assert notes[("all", "p")] == ("EXTREME OUTLIERS PRESENT", 8, 4)
    assert notes[("all", "q")] == ("insufficient observations", 1, 2)


def test_paired_differences_and_long_form(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(9)] + [(9, 500.0, 0.0)], "id int, fvc double, lvc double")
    got = {r.id: (r.difference, r.is_extreme) for r in summ.paired_differences(df, "fvc", "lvc").collect()}
    assert got[9] == (500.0, True) and got[3] == (-3.0, False)
    assert summ.wide_to_long(df, "id", ["fvc", "lvc"]).count() == 20
    summary = {r.variable: r for r in summ.column_summary(df, ["fvc", "lvc"]).collect()}
    assert summary["lvc"].median == pytest.approx(np.median([2 * i for i in range(9)] + [0]))


PAIN_X, PAIN_Y = [1, 2, 1, 1, 1, 1, 1, 1, 1, 1, 2, 4, 1, 1], [3, 3, 4, 3, 1, 2, 3, 1, 1, 5, 4]


def pain(spark, x="FVC", y="LVC"):
    data = [("pain", x, i, float(v)) for i, v in enumerate(PAIN_X)] + [("pain", y, 100 + i, float(v)) for i, v in enumerate(PAIN_Y)]
    data += [("apart", "FVC", 1, 1.0), ("apart", "FVC", 2, 2.0), ("apart", "LVC", 3, 3.0), ("apart", "LVC", 4, 4.0), ("few", "FVC", 1, 1.0), ("few", "LVC", 2, 2.0), ("few", "LVC", 3, 0.0)]
    return spark.createDataFrame(data, "pair string, kind string, row long, score double")


def test_brunner_munzel_on_the_pain_scores(spark, many_slices):
    got = {r.pair: r for r in hyp.brunner_munzel(pain(spark)).collect()}
    r = got["pain"]
    want = (3.1374674823029505, 17.682841979481548, 0.005786208666151538, 0.788961038961039, 0.5952169, 0.9827052)
    assert (r.statistic, r.df, r.p_two_sided, r.relative_effect, r.ci_lower, r.ci_upper) == pytest.approx(want, rel=1e-6)
    assert r.p_greater == pytest.approx(r.p_two_sided / 2) and (r.fvc_n, r.lvc_n) == (14, 11)
    pairs = [(x < y) + (x == y) / 2 for x in PAIN_X for y in PAIN_Y]
    assert r.relative_effect == pytest.approx(sum(pairs) / len(pairs))
    assert got["apart"].statistic is None and got["apart"].p_greater is None and got["apart"].relative_effect == 1.0
    assert got["few"].statistic is None and (got["few"].fvc_n, got["few"].lvc_n) == (1, 2)
    swapped = {r.pair: r for r in hyp.brunner_munzel(pain(spark, "LVC", "FVC")).collect()}["pain"]
    assert swapped.relative_effect == pytest.approx(1 - r.relative_effect) and swapped.statistic == pytest.approx(-r.statistic)


def brunner_munzel_by_hand(x, y):
    def ranks(values, among):
        among = np.array(among)
        return np.array([(among < v).sum() + ((among == v).sum() + 1) / 2 for v in values])

    n, m, both = len(x), len(y), x + y
    rx, ry = ranks(x, both), ranks(y, both)
    sx = ((rx - ranks(x, x) - rx.mean() + (n + 1) / 2) ** 2).sum() / (n - 1)
    sy = ((ry - ranks(y, y) - ry.mean() + (m + 1) / 2) ** 2).sum() / (m - 1)
    shift = ry.mean() - rx.mean()
    return np.inf * np.sign(shift) if n * sx + m * sy == 0 else n * m * shift / ((n + m) * np.sqrt(n * sx + m * sy))


def test_permutations_against_brute_force(spark, many_slices):
    n_perm = 40
    r = {r.pair: r for r in hyp.brunner_munzel_permutation(pain(spark), n_perm).collect()}["pain"]
    data = list(enumerate(PAIN_X)) + [(100 + i, v) for i, v in enumerate(PAIN_Y)]
    draws = []
    for k in range(1, n_perm + 1):
        shuffled = sorted(data, key=lambda d: hashlib.md5(f"1|{k}|pain|{d[0]}".encode()).hexdigest())
        values = [v for _, v in shuffled]
        draws.append(brunner_munzel_by_hand(values[: len(PAIN_X)], values[len(PAIN_X):]))
    seen = brunner_munzel_by_hand(PAIN_X, PAIN_Y)
    assert r.statistic == pytest.approx(seen)
    assert r.p_greater == pytest.approx(np.mean(np.array(draws) >= seen))
    low, high = np.quantile(draws, [0.025, 0.975])
    se = (r.relative_effect - r.ci_lower) / high
    assert (r.relative_effect - r.ci_upper) / low == pytest.approx(se)


def test_corrections(spark, many_slices):
    tests = spark.createDataFrame([("a", p) for p in (0.005, 0.01, 0.03, 0.04, 0.5)] + [("b", 0.02), ("b", 0.02), ("b", 0.9)], "family string, p_value double")
    got = defaultdict(list)
    for r in hyp.benjamini_hochberg(tests, ["family"]).orderBy("p_value").collect():
        got[r.family].append(r.p_bh)
    assert got["a"] == pytest.approx([0.025, 0.025, 0.05, 0.05, 0.5]) and got["b"] == pytest.approx([0.03, 0.03, 0.9])

    p = np.array(sorted(r.p_value for r in tests.collect()))
    whole = [r.p_bh for r in hyp.benjamini_hochberg(tests).orderBy("p_value").collect()]
    raw = p * len(p) / np.arange(1, len(p) + 1)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert whole == pytest.approx(list(want))
    bonferroni = [r.p_bonferroni for r in hyp.bonferroni(tests).orderBy("p_value").collect()]
    assert bonferroni == pytest.approx(list(np.minimum(1, p * 8)))
    assert hyp.bonferroni(tests, ["family"]).filter("family = 'b'").first().p_bonferroni == pytest.approx(0.06)


SLEEP_1 = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0]
SLEEP_2 = [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]


def test_paired_t_on_the_sleep_data(spark):
    df = spark.createDataFrame(list(zip(SLEEP_1, SLEEP_2)), "lvc double, fvc double")
    r = hyp.paired_t(df).first()
    assert (r.t, r.df, r.p_two_sided, r.mean_difference, r.ci_lower, r.ci_upper) == pytest.approx((-4.0621277, 9, 0.0028329, -1.58, -2.4598858, -0.7001142), rel=1e-5)
    assert r.p_greater == pytest.approx(1 - r.p_two_sided / 2)
    d = np.array(SLEEP_1) - np.array(SLEEP_2)
    within = d.std(ddof=1) / np.sqrt(2 * (1 - np.corrcoef(SLEEP_1, SLEEP_2)[0, 1]))
    assert hyp.paired_cohen_d(df).first().cohen_d == pytest.approx(d.mean() / within)


# fuel use of 32 cars (Henderson and Velleman 1981)
MILES = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]


def test_shapiro_wilk_on_published_samples(spark, many_slices):
    data = [("cars", float(x)) for x in MILES] + [("sleep", x) for x in SLEEP_1] + [("three", x) for x in (1.0, 2.0, 4.0)] + [("flat", 1.0)] * 4 + [("two", 1.0), ("two", 2.0)]
    got = {r.g: r for r in hyp.shapiro_wilk(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    assert (got["cars"].w, got["cars"].p_value) == pytest.approx((0.94756, 0.1229), abs=5e-5)
    assert (got["sleep"].w, got["sleep"].p_value) == pytest.approx((0.92581, 0.4079), abs=5e-5)
    assert got["three"].w == pytest.approx(0.9642857) and got["three"].p_value == pytest.approx(0.6368868, abs=1e-6)
    assert got["flat"].w is None and got["two"].w is None


def test_distributions(spark):
    one = spark.range(1)
    row = one.select(
        t_quantile(0.975, F.lit(9.0)), t_two_sided(F.lit(2.262157), F.lit(9.0)), t_upper(F.lit(-1.0), F.lit(5.0)),
        t_quantile(0.975, F.lit(1.0)), normal_upper(F.lit(1.959963985)), normal_quantile(F.lit(0.975)),
        normal_quantile(F.lit(1e-12)), normal_quantile(F.lit(0.4)), t_quantile(0.975, F.lit(400.0)),
    ).first()
    want = (2.2621572, 0.05, 0.8183913, 12.7062047, 0.025, 1.9599640, -7.0344838, -0.2533471, 1.9659123)
    assert tuple(row) == pytest.approx(want, rel=1e-6)


# Two-sided p of t at df degrees of freedom.
KNOWN_T = [
    (1.0, 1.0, 0.5), (12.706204736432095, 1.0, 0.05), (1e6, 1.0, 6.366197723673689e-07), (2.2621571627409915, 9.0, 0.05), (0.0, 9.0, 1.0),
]


def large_df(t, df):
    """Two-sided p from the normal limit with its correction terms in 1 / df (Hill 1970)."""
    a = df - 0.5
    b = 48 * a * a
    z2 = a * math.log1p(t * t / df)
    u = math.sqrt(z2)
    z = u * (1 + (((-0.4 * z2 - 3.3) * z2 - 24) * z2 - 85.5) / (0.8 * z2 * z2 + 100 + b) / b + (z2 + 3) / b)
    return math.erfc(z / math.sqrt(2))


def test_t_tails_at_any_df(spark):
    cases = [*KNOWN_T, *[(t, df, large_df(t, df)) for df in (1e4, 1e6, 1e8, 1e12) for t in (0.3, 0.999, 1.0, 1.001, 1.96, 5.0, 20.0)]]
    rows = spark.createDataFrame([(t, df) for t, df, _ in cases], "t double, df double").select("t", "df", t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    got = {(r.t, r.df): r.p for r in rows}
    for t, df, p in cases:
        assert got[t, df] == pytest.approx(p, rel=1e-9), (t, df)
    reach = spark.range(1).select(*[t_quantile(0.975, F.lit(df)) for df in (1e6, 1e7, 1e12)]).first()
    assert tuple(reach) == pytest.approx((1.959966357, 1.959964222, 1.959963985), abs=2e-9)
    z = spark.range(1).select(*[normal_upper(F.lit(x)) for x in (0.5, 1.0, 8.5, 20.0, -8.5, 38.0)]).first()
    assert tuple(z) == pytest.approx([math.erfc(x / math.sqrt(2)) / 2 for x in (0.5, 1.0, 8.5, 20.0, -8.5, 38.0)], rel=1e-9)


def test_t_quantiles_at_any_df(spark):
    ps = (0.6, 0.9, 0.975, 0.9995)
    one = {(p, 1.0): math.tan(math.pi * (p - 0.5)) for p in ps}
    two = {(p, 2.0): (2 * p - 1) * math.sqrt(2 / (4 * p * (1 - p))) for p in ps}
    dfs = (1.0, 1.3, 2.0, 3.0, 7.5, 30.0, 1e4, 1e8, 1e12)
    frame = spark.createDataFrame([(df,) for df in dfs], "df double")
    found = frame.select("df", *[t_quantile(p, F.col("df")).alias(str(p)) for p in ps])
    tails = found.select("df", *[F.struct(F.col(f"`{p}`").alias("t"), t_two_sided(F.col(f"`{p}`"), F.col("df")).alias("p")).alias(str(p)) for p in ps])
    for r in tails.collect():
        for p in ps:
            assert r[str(p)].p == pytest.approx(2 * (1 - p), rel=1e-9)
            assert r[str(p)].t == pytest.approx({**one, **two}.get((p, r.df), r[str(p)].t), rel=1e-9)
    assert spark.range(1).select(t_quantile(0.975, F.lit(None).cast("double")).alias("t")).first().t is None


def test_shapiro_wilk_beyond_its_calibration_and_with_ties(spark, many_slices):
    values = [float(i % 7 if i % 10 < 3 else 3) for i in range(6000)]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[:5000]], "g string, v double")
    got = {r.g: r for r in hyp.shapiro_wilk(frame, ["g"], "v").collect()}
    assert (got["a"].calibrated, got["b"].calibrated) == (False, True)
    assert 0 <= got["a"].p_value < 1e-10 and 0 <= got["b"].p_value < 1e-10


def test_null_scores_take_no_part(spark):
    rows = [("p", k, i, float(v)) for i, (k, v) in enumerate(zip(["FVC", "LVC"] * 8, [1, 2, 3, 4, 2, 6, 5, 3, 4, 8, 1, 2, 6, 9, 7, 8]))]
    nulls = [("p", k, 100 + i, None) for i, k in enumerate(["LVC"] * 4)]
    schema = "pair string, kind string, row long, score double"
    plain, more = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + nulls, schema)
    assert hyp.brunner_munzel(plain).collect() == hyp.brunner_munzel(more).collect()
    assert hyp.brunner_munzel_permutation(plain, 20).collect() == hyp.brunner_munzel_permutation(more, 20).collect()
    kept = summ.remove_outliers(more, ["pair"], "score", "all")
    assert kept.count() == 20
    assert summ.pair_notes(more, "all").first().lvc_n == summ.pair_notes(more, "none").first().lvc_n == 12
    empty = summ.column_summary(more.withColumn("none", F.lit(None).cast("double")), ["score", "none"]).filter("variable = 'none'").first()
    assert empty.n == 0 and empty["median"] is None


def test_a_construction_is_tested_against_each_plain_verb_by_itself(spark):
    groups = [("take", "walk", "walk", True), ("take", "walk", "stroll", True), ("take", "walk", "march", False), ("have", "walk", "walk", True)]
    corresponding = spark.createDataFrame(groups, "lv_pos string, nominal_pos string, fvc_pos string, fvc_observed boolean")
    scores = spark.createDataFrame(
        [("take_walk", "LVC", 1.0), ("have_walk", "LVC", 2.0), ("walk", "FVC", 3.0), ("stroll", "FVC", 4.0), ("march", "FVC", 5.0), ("walk", "FVC", None)],
        "construction string, kind string, score double",
    )
    got = sorted(tuple(r) for r in cons.score_table(corresponding, scores).collect())
    assert got == [
        ("have_walk_walk", "FVC", 3.0), ("have_walk_walk", "LVC", 2.0), ("take_walk_stroll", "FVC", 4.0), ("take_walk_stroll", "LVC", 1.0),
        ("take_walk_walk", "FVC", 3.0), ("take_walk_walk", "LVC", 1.0),
    ]


def test_tasks_of_a_permutation_test_grow_with_its_draws(spark, monkeypatch):
    monkeypatch.setattr(hyp, "DRAWS_A_TASK", 1000)
    values = spark.range(1000, numPartitions=2).selectExpr("'p' AS pair", "CAST(id AS double) AS _value", "id AS _row")
    dealt = hyp._dealt_by_draws(values, 50)
    assert dealt.rdd.getNumPartitions() == 50 and dealt.count() == 1000
    assert max(dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 60
    assert hyp._dealt_by_draws(values, 1).rdd.getNumPartitions() == 2
