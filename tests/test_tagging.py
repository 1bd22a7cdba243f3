"""Words, tags and parses of whole batches of lines, against plain Python."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest

from semaspan.operators.constructions import extract_sentences, sentence_hits
from semaspan.workload import tagging, views

LINES = ["", " -- ", None, "a1b2 3c", "--x__y--", "on 5 abcde the abcd on", "the " * 60, "ΐé ½ ٣٤ 日本12", "y" * 16, "abcde abcdefgh abcd ab abcd"]


def plain(line):
    return None if line is None else re.findall(r"[^\W\d_]+|[0-9]+", re.sub("[½٣٤]", " ", line))


def test_words_are_runs_of_letters_and_runs_of_digits():
    assert tagging.words(pa.array(LINES, pa.string())).to_pylist() == [plain(x) for x in LINES]
    assert tagging.words(pa.array([], pa.string())).to_pylist() == []
    assert tagging.words(pa.array([None], pa.string())).to_pylist() == [None]


def test_tags_come_from_digits_lists_and_lengths():
    tagged = tagging.tagged(pa.array(["5on the on ab abcd abcde " + "z" * 16, None, ""])).to_pylist()
    assert tagged == [["5_ADJ", "on_PREP", "the_ART", "on_PREP", "ab_ADJ", "abcd_SUBST", "abcde_VERB", "z" * 16 + "_UNC"], None, []]


def test_tagged_places_spell_the_tagged_words():
    lines = pa.array(LINES, pa.string())
    places = tagging.tagged_places(lines)
    assert places.to_pylist() == tagging.tagged(lines).to_pylist()
    assert places.cast(pa.list_(pa.string())).equals(tagging.tagged(lines))
    assert len(places.values.dictionary.unique()) == len(places.values.dictionary) < len(places.values)


def test_heads_stand_in_the_same_line():
    lines = pa.array(["abcde", "abcd", "abcde abcde of abcd of ab abcd on", None])
    found = tagging.annotated(lines, pa.array([0, 1, 2, 3])).to_pylist()
    assert [(t["upos"], t["deprel"], t["head"]) for t in found[1]] == [("NOUN", "dep", 0)]
    assert [t["head"] for t in found[2]] == [0, 0, 0, 2, 0, 0, 0, 0] and [t["id"] for t in found[2]] == list(range(1, 9))
    assert found[3] is None


def test_words_of_a_parsed_line_are_taken_once(monkeypatch):
    taken = []
    monkeypatch.setattr(tagging, "words_of", lambda lines, f=tagging.words_of: taken.append(1) or f(lines))
    lines, numbers = pa.array(LINES, pa.string()), pa.array(range(len(LINES)), pa.int64())
    both = tagging.parsed(lines, numbers)
    assert len(taken) == 1
    assert both.field("ws").equals(tagging.tagged(lines)) and both.field("annotated").equals(tagging.annotated(lines, numbers))


def test_every_fiftieth_element_is_truncated():
    body = tagging.elements(pa.array(["ab " * 101, ""])).to_pylist()
    assert body[0].count("<trunc>") == 2 and body[0].count("<w ") == 101 and body[1] == ""


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(1, "s", "en", "abcde abcd\nabcd 7 abcde abcd"), (2, "s", "en", "abcde the abcd")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_explosions_tag_a_line_once(spark, corpus):
    plan = views.sentences(spark, corpus).selectExpr("explode(ws) AS w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


def test_extraction_reads_the_corpus_before_it_compares_words(spark, corpus):
    pairs = spark.createDataFrame([("abcde_VERB", "abcd_SUBST", "abcde_VERB")], "lv_pos string, nominal_pos string, fvc_pos string")
    words = spark.createDataFrame([("abcde_VERB",), ("abcd_SUBST",)], "lemma_pos string")
    found = extract_sentences(views.parsed(spark, corpus), pairs, words, views.SENTENCE, "doc_id", max_pairs=10, max_words=10)
    # what was found is stored, so no reader parses the corpus again
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [
        ("abcde_VERB", "FVC", 1, 0, "abcde_VERB abcd_SUBST"),
        ("abcde_VERB", "FVC", 1, 1, "abcd_SUBST --anonnumeral_ADJ abcde_VERB abcd_SUBST"),
        ("abcde_VERB_abcd_SUBST", "LVC", 1, 0, "abcde_VERB abcd_SUBST"),
        ("abcde_VERB_abcd_SUBST", "LVC", 1, 1, "abcd_SUBST --anonnumeral_ADJ abcde_VERB abcd_SUBST"),
    ]


def test_hits_are_found_by_id_in_compiled_code(spark):
    """Heads are taken by id where ids do not number the tokens; the first of equal ids counts, and no lambda runs for each token."""
    rows = [
        (1, ["x"], [(7, "take", "VERB", "dep", 0), (7, "give", "VERB", "dep", 0), (3, "walk", "NOUN", "obj", 7), (4, "walk", "NOUN", "obj", 9)]),
        (2, ["y"], [(1, "take", "VERB", "dep", 0), (2, "walk", "NOUN", "obj", 1), (3, "walk", "NOUN", "obj", None), (4, None, None, None, 1)]),
        (3, ["z"], None), (4, None, []),
    ]
    parsed = spark.createDataFrame(
        rows, "line_no long, ws array<string>, annotated array<struct<id: int, lemma: string, upos: string, deprel: string, head: int>>"
    )
    pairs = spark.createDataFrame([("take_VERB", "walk_SUBST", "give_VERB")], "lv_pos string, nominal_pos string, fvc_pos string")
    hits = sentence_hits(parsed, pairs, ["line_no"], "ws", 10)
    got = sorted((r.line_no, r.ws, r.construction, r.kind) for r in hits.collect())
    assert got == [(1, ["x"], "give_VERB", "FVC"), (1, ["x"], "take_VERB_walk_SUBST", "LVC"), (2, ["y"], "take_VERB_walk_SUBST", "LVC")]
    assert "lambda" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_tags_of_odd_characters_stay_in_arrow():
    rng = random.Random(5)
    pool = [chr(c) for c in (0x41, 0x61, 0x31, 0x20, 0x2D, 0xE9, 0x301, 0x663, 0x65E5, 0x1F600, 0x10400, 0x1D7CE, 0x2160, 0xAA, 0xFFFD)]
    odd = [None if rng.random() < 0.1 else "".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(2_000)]

    def runs(line):
        kind = ["d" if "0" <= c <= "9" else "l" if unicodedata.category(c)[0] == "L" else " " for c in line]
        return [line[m.start():m.end()] for m in re.finditer("d+|l+", "".join(kind))]

    lines = pa.array(["x", *odd], pa.string())[1:]  # a slice, as its bytes do not start at the first
    assert tagging.words(lines).to_pylist() == [None if x is None else runs(x) for x in odd]
    tokens = tagging._Tokens(lines)
    assert isinstance(tokens.words, pa.Array) and len(tokens.tags) == len(tokens.words)
