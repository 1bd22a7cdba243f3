"""Readers, writers and incremental runs on small files."""

import glob
import os
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semaspan.operators.constructions import align_renditions
from semaspan.operators.cooccurrence import assemble_vectors
from semaspan.operators.vectors import to_long
from semaspan.operators.vocabulary import fold_numerals
from semaspan.plans.joins import lookup_join
from semaspan.sources import sinks, tables
from semaspan.sources.corpus import read_corpus, read_group_values, read_groups, read_numbered_corpus
from semaspan.sources.group_files import write_group_files
from semaspan.sources.xml import (
    SPOKEN_2014, WRITTEN_AND_SPOKEN, _Reader, kept_tokens, prepare_corpus, read_xml_sentences, rendered_tokens, sentence_tokens,
)
from semaspan.streaming.incremental import accumulated_counts, count_new_files
from semaspan.workload import queries, views


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("text", [
    "1|20|the_ART\n2|5|\"_PUNC\n",
    "     1 20 the_ART\n     2 5 \"_PUNC\n",
    "1|the|ART|20\n2|\"|PUNC|5\n",
    "1 the ART 20\n2 \" PUNC 5\n",
])
def test_frequency_lists(spark, tmp_path, text):
    rows = tables.read_freqs(spark, put(tmp_path, "f.txt", text)).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(1, 20, "the_ART"), (2, 5, "\"_PUNC")]


def test_count_space_and_scale(spark, tmp_path):
    space = tables.read_vector_space(spark, put(tmp_path, "v.txt", "a_X|[[0, 3], [7, 1]]\nb_X|[]\n"))
    assert {r.lemma_pos: r.vector for r in space.collect()} == {"a_X": [[0, 3], [7, 1]], "b_X": []}
    scale = tables.read_scale(spark, put(tmp_path, "s.txt", "category|ppmi\ncategory1|[[0.0, 1.5]]\ncategory2|[[2.0, 0.5]]\n"))
    assert {r.category: r.ppmi for r in scale.collect()} == {"category1": [[0.0, 1.5]], "category2": [[2.0, 0.5]]}


@pytest.mark.parametrize("text", [
    "lemma_pos|ppmi\na_X|[[0.0, 1.25], [3.0, 2.0]]\n",
    "lemma\tpos\tppmi\na\tX\t[[0.0, 1.25], [3.0, 2.0]]\n",
])
def test_ppmi_spaces(spark, tmp_path, text):
    put(tmp_path, "p/part-0.csv", text)
    got = tables.read_ppmi_vector_space(spark, str(tmp_path / "p")).collect()
    assert [(r.lemma_pos, r.ppmi) for r in got] == [("a_X", [[0.0, 1.25], [3.0, 2.0]])]


def test_rating_files(spark, tmp_path):
    tabs = tables.read_ratings(spark, put(tmp_path, "a", "gem\tjewel\t\t3.84\nboy\tlad\t3.76\n"), "NN").collect()
    assert [tuple(r) for r in tabs] == [("gem", "jewel", 3.84), ("boy", "lad", 3.76)]
    suffix = tables.read_ratings(spark, put(tmp_path, "b", "sun-n sunlight-n 50.0\n"), "suffix").collect()
    assert [tuple(r) for r in suffix] == [("sun-n", "sunlight-n", 50.0)]
    named = tables.read_ratings(
        spark, put(tmp_path, "c", "w1\tw2\tPOS\tscore\told\nold\tnew\tA\t1.58\tx\n"), "pos-column", "w1", "w2", "score", "POS"
    ).collect()
    assert [tuple(r) for r in named] == [("old", "new", 1.58, "A")]


def test_pairs_seeds_and_words(spark, tmp_path):
    pairs = tables.read_pairs(spark, put(tmp_path, "p", "id,LV_POS,nominal_POS,FVC_POS\n1,give_VERB,kiss_SUBST,kiss_VERB\n"))
    assert [tuple(r) for r in pairs.collect()] == [("give_VERB", "kiss_SUBST", "kiss_VERB")]
    assert [tuple(r) for r in tables.read_seeds(spark, put(tmp_path, "s", "lemma_pos,category\nday_SUBST,2\n")).collect()] == [("day_SUBST", 2)]
    assert [r.lemma_pos for r in tables.read_words(spark, put(tmp_path, "w", "word,x\nhour_SUBST,1\n")).collect()] == ["hour_SUBST"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = {f: [f"{f}_{i}_{'x' * (i % 17)}" for i in range(400)] for f in ("a", "b")}
    for f, rows in lines.items():
        put(tmp_path, f"{f}.txt", "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        corpus = read_numbered_corpus(spark, str(tmp_path))
        assert read_corpus(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = {(os.path.basename(r.file)[0], r.line_no): r.value for r in corpus.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(f, i): v for f, rows in lines.items() for i, v in enumerate(rows)}


def test_group_folders(spark, tmp_path):
    put(tmp_path, "kiss_VERB.txt", "a b\nc\n")
    put(tmp_path, "deep/give_VERB_kiss_SUBST.txt", "d\n")
    put(tmp_path, "other.csv", "no\n")
    got = sorted(map(tuple, read_groups(spark, str(tmp_path)).collect()))
    assert got == [("give_VERB_kiss_SUBST", "d"), ("kiss_VERB", "a b"), ("kiss_VERB", "c")]
    put(tmp_path, "n/kiss_VERB.txt", "1.5\n\n-2\n")
    assert sorted(r.score for r in read_group_values(spark, str(tmp_path / "n")).collect()) == [-2.0, 1.5]


NAMES = ["007", "7", "a/b", "", None, ".x", "_y", "~1", "x", "x~1", "50%", "%41", "ü ß", "a+b", "k:l", "b\\c", "n\nl", "g=h", "q.txt", "%", "%%"]


def test_group_files(spark, tmp_path, monkeypatch, many_slices):
    """Any group name comes back from its files, also a large group's, from folders in folders."""
    monkeypatch.setattr("semaspan.sources.sinks.FILE_ROWS", 40)
    rows = [(n, f"line {i}", i) for i, n in enumerate(NAMES)] + [("x", f"more {i}", 0) for i in range(200)]
    rows += [("007", None, 1), ("007", "", 1), ("007", "twice", 1), ("007", "twice", 1)]
    groups = spark.createDataFrame(rows, "construction string, sentence string, line int")
    write_group_files(groups, str(tmp_path / "deep" / "er"))
    got = map(tuple, read_groups(spark, str(tmp_path)).collect())
    assert Counter(got) == Counter((n, s or "") for n, s, _ in rows)
    names = {f.name for f in (tmp_path / "deep" / "er").iterdir() if not f.name.startswith(".")}
    assert {"007.txt", "x.txt", "x~1.txt", "x%7E1.txt", "%2Ex.txt", "%.txt", "%%.txt", "ü ß.txt", "_SUCCESS"} <= names
    assert not any(n.startswith("_staged") for n in names)
    with pytest.raises(FileExistsError):
        write_group_files(groups, str(tmp_path / "deep" / "er"))


def test_group_files_of_nothing_and_of_a_failed_task(spark, tmp_path):
    groups = spark.createDataFrame([("a", "x"), ("b", "y")], "construction string, sentence string")
    write_group_files(groups.limit(0), str(tmp_path / "none"))
    assert read_groups(spark, str(tmp_path / "none")).collect() == []
    broken = F.when(F.col("construction") == "b", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("sentence"))
    with pytest.raises(Exception, match="lost"):
        write_group_files(groups.withColumn("sentence", broken), str(tmp_path / "failed"))
    assert list((tmp_path / "failed").iterdir()) == []


def test_numerals_fold_beside_tokens_without_a_lemma(spark):
    """Tokens without one lemma and one tag stay, even where a lexicon lists what they are looked up by."""
    freqs = spark.createDataFrame([("ten_NUM", 5), ("two_NUM", 2), ("x", 3), ("a_b_c", 4), ("_", 1)], "lemma_pos string, freq long")
    lexicon = spark.createDataFrame([("ten",), ("two",), (" x",), (None,)], "lemma string")
    got = {r.lemma_pos: r.freq for r in fold_numerals(freqs, lexicon, ranked=False).collect()}
    assert got == {"--anonnumeral_NUM": 7, "x": 3, "a_b_c": 4, "_": 1}


def test_salt_splits_a_key_without_other_columns(spark):
    stream = spark.createDataFrame([("hot",)] * 64, "key string").coalesce(1)
    joined = lookup_join(stream, spark.createDataFrame([("hot", 1)], "key string, n long"), "key", salts=8)
    assert joined.count() == 64
    salted = lookup_join(stream, spark.createDataFrame([("hot", 1)], "key string, n long").hint("shuffle_hash"), "key", salts=8)
    assert "monotonically_increasing_id" in salted._jdf.queryExecution().optimizedPlan().toString()


WRITTEN = """<?xml version="1.0"?>
<text><p><s n="1"><w c5="PNP" hw="it" pos="PRON">It </w><w c5="X" hw="be" pos='VERB'>'s </w><trunc><w c5="UNC" hw="w" pos="UNC">w </w></trunc>
<w c5="AT0" hw="the" pos="ART">the </w><!-- <w hw="not" pos="X">not</w> --><w c5="NN1" pos="SUBST">R&amp;D &lt;x&gt; </w><c c5="PUN">.</c></s></p>
<sp><s n="2"><c c5="PUN">...</c></s></sp><s n="3"><trunc>gone</trunc><c c5="PUN">,</c><w hw="oh" pos="INTERJ">Oh </w><w hw="yes" pos="ADV">yes</w></s></text>"""

SPOKEN = """<text><u n="1"><w class="PRON" lemma="i" pos="PPIS1">I</w><trunc>th</trunc><w class="PUNC" lemma="PUNC" pos="YQUE">?</w>
<w class="VERB" lemma="see" pos="VVD">saw</w><w class="SUBST" lemma="cat" pos="NN2">cats</w></u></text>"""


def tokens_of(spark, path, dialect):
    rows = read_xml_sentences(spark, path, dialect).withColumn("t", sentence_tokens(F.col("xml"), dialect))
    return {r.line_no: [(t.kind[0], t.pos, t.lemma, t.text, t.truncated) for t in r.t] for r in rows.collect()}


def test_xml_tokens_keep_order_and_survive_missing_attributes(spark, tmp_path):
    got = tokens_of(spark, put(tmp_path, "a.xml", WRITTEN), WRITTEN_AND_SPOKEN)
    assert got[0] == [
        ("w", "PRON", "it", "It ", False), ("w", "VERB", "be", "'s ", False), ("w", "UNC", "w", "w ", True),
        ("w", "ART", "the", "the ", False), ("w", "SUBST", None, "R&D <x> ", False), ("p", None, None, ".", False),
    ]
    assert [t[3] for t in got[1]] == ["..."]
    # the truncation mark waits for the next word, whatever stands between
    assert got[2] == [("p", None, None, ",", False), ("w", "INTERJ", "oh", "Oh ", True), ("w", "ADV", "yes", "yes", False)]


ODD = [
    '<s><w hw="a<w>b" pos="X">one</w><w hw="c">two</s>', "<s><w hw='' pos=\"Y\"/><corr n='1'>x</corr><c>!</c><w>z</s>",
    '<s><!-- <trunc> <w> --><trunc r="1"><c>,</c><w hw="\u00e9&amp;" pos="A\nB">\u2003&lt;y\u00a0</w></trunc><w hw="q"', None, "",
]
ODD_TOKENS = [
    [("w", "X", "a<w>b", "one", False), ("w", None, "c", "two", False)],
    [("w", "Y", "", "", False), ("p", None, None, "!", False), ("w", None, None, "z", False)],
    [("p", None, None, ",", False), ("w", None, "\u00e9&", "\u2003<y\u00a0", True)], None, [],
]


def test_elements_are_read_in_batches_and_once(spark, monkeypatch):
    monkeypatch.setattr("semaspan.sources.xml.REMEMBERED_ELEMENTS", 3)  # the driver's reader only
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "i int, xml string").withColumn("t", sentence_tokens(F.col("xml")))
    got = [r.t if r.t is None else [(t.kind[0], t.pos, t.lemma, t.text, t.truncated) for t in r.t] for r in rows.orderBy("i").collect()]
    assert got == ODD_TOKENS * 3
    reader = _Reader(WRITTEN_AND_SPOKEN)
    for _ in range(2):
        found = reader.tokens(pa.array(ODD, pa.string()).slice(1)).to_pylist()
        assert [x and len(x) for x in found] == [3, 2, None, []]
    stripped = rows.filter("i = 2").select(rendered_tokens(F.col("t"), lemmatise=False, pos_tags=False)).first()[0]
    assert stripped == [",", "<y"]
    plan = rows.select(F.posexplode(kept_tokens(F.col("t")))).filter("pos > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("read(") == 1 and "regexp_extract" not in plan


def test_second_dialect(spark, tmp_path):
    got = tokens_of(spark, put(tmp_path, "a.xml", SPOKEN), SPOKEN_2014)
    assert [(t[0], t[1], t[2], t[4]) for t in got[0]] == [
        ("w", "PRON", "i", False), ("p", "PUNC", "PUNC", False), ("w", "VERB", "see", True), ("w", "SUBST", "cat", False),
    ]


def test_token_classes_and_forms(spark, tmp_path):
    rows = read_xml_sentences(spark, put(tmp_path, "a.xml", WRITTEN)).filter("line_no = 0").withColumn("t", sentence_tokens(F.col("xml")))

    def forms(lemmatise, pos_tags, **kept):
        return rows.select(rendered_tokens(kept_tokens(F.col("t"), **kept), lemmatise, pos_tags)).first()[0]

    assert forms(False, True, punctuation=True, unclassified=True, truncated=True) == [
        "It_PRON", "'s_VERB", "w_UNC", "the_ART", "R&D <x>_SUBST", "._PUNC",
    ]
    assert forms(False, False, articles=False) == ["It", "'s", "R&D <x>"]
    assert forms(True, True, truncated=True, unclassified=True)[:3] == ["it_PRON", "be_VERB", "w_UNC"]


def test_renditions_align_although_sentences_are_dropped(spark, tmp_path):
    sentences = read_xml_sentences(spark, put(tmp_path, "a.xml", WRITTEN)).filter("xml NOT LIKE '%R&amp;D%'")
    tagged = prepare_corpus(sentences, articles=False, interjections=False, truncated=True)
    plain = prepare_corpus(sentences, lemmatise=False, pos_tags=False, punctuation=True, truncated=True)
    assert {r.line_no: r.value for r in plain.collect()} == {1: "... ", 2: ", Oh yes "}
    both = align_renditions(tagged.withColumnRenamed("value", "tagged"), plain.withColumnRenamed("value", "plain"))
    assert [(r.line_no, r.tagged, r.plain) for r in both.collect()] == [(2, "yes_ADV ", ", Oh yes ")]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("a_X", 3, 2), ("a_X", 1, 5)], "lemma_pos string, basis_index int, n long")
    targets = spark.createDataFrame([(0, "a_X"), (1, "b_X")], "voc_index int, lemma_pos string")
    vectors = assemble_vectors(cells, targets)
    path = str(tmp_path / "vs")
    sinks.write_count_space(vectors, path)
    sinks.write_count_space(vectors.filter("voc_index < 0"), path)  # already there: left alone
    assert {r.lemma_pos: r.vector for r in tables.read_vector_space(spark, path).collect()} == {"a_X": [[1, 5], [3, 2]], "b_X": []}
    weights = spark.createDataFrame([("a_X", [[0.0, 1.5]]), ("\"_PUNC", [])], "lemma_pos string, ppmi array<array<double>>")
    for _ in range(2):  # overwritten
        sinks.write_vector_space(weights, str(tmp_path / "ppmi"))
    read = tables.read_ppmi_vector_space(spark, str(tmp_path / "ppmi"))
    assert {r.lemma_pos: r.ppmi for r in read.collect()} == {"a_X": [[0.0, 1.5]], "\"_PUNC": []}
    assert to_long(read, "ppmi", "x").count() == 1
    groups = spark.createDataFrame([("g1", "s 1"), ("g2", "s 2")], "construction string, sentence string")
    for _ in range(2):  # appended
        sinks.write_groups(groups, str(tmp_path / "groups"))
    assert sinks.read_written_groups(spark, str(tmp_path / "groups")).count() == 4


def test_incremental_counts_see_each_file_once(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("corpus", "counts", "state")]
    put(folders[0], "1.txt", "a_X b_X a_X \n")
    count_new_files(spark, *folders)
    put(folders[0], "2.txt", "a_X c_X \n")
    count_new_files(spark, *folders)
    count_new_files(spark, *folders)  # nothing new
    assert {r.lemma_pos: r.freq for r in accumulated_counts(spark, folders[1]).collect()} == {"a_X": 3, "b_X": 1, "c_X": 1}


def test_scanned_xml_is_stored_small_and_whole(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/xml"
    monkeypatch.setattr(queries, "scratch_folder", lambda _: folder)
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["xml_scan"](spark, sf)
    want = sorted(r.xml for r in views.xml_rows(spark, sf).select("xml").collect())
    assert sorted(r.xml for r in rows.collect()) == want
    stored = sum(os.path.getsize(f) for f in glob.glob(f"{folder}/part-*"))
    assert 0 < stored < sum(len(x.encode()) for x in want) / 4


def test_compressed_sentences_are_numbered_inside_their_file(spark, tmp_path):
    texts = spark.range(500).select(F.format_string("<s n=\"%d\"><w pos=\"A\" hw=\"b\">b </w></s>", "id").alias("xml"))
    sinks.write_text_once(texts.repartition(3), f"{tmp_path}/xml", "gzip")
    read = read_xml_sentences(spark, f"{tmp_path}/xml").collect()
    assert sorted(r.xml for r in read) == sorted(r.xml for r in texts.collect())
    files = {f: sorted(r.line_no for r in read if r.file == f) for f in {r.file for r in read}}
    assert len(files) == 3 and all(f.endswith(".gz") and n == list(range(len(n))) for f, n in files.items())
