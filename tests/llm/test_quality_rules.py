import re
from collections import Counter

from semaspan.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


ODD = ["", " \n\t", "a b", "a b c", "a a a a a", "x y z x y z", "\x0b a\x0cb\r\nc d\n\na b\nc d", "é ü ß 𝄞 #|", "one\none\n one\none"]


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(ODD)], docs.schema)
    both = docs.union(odd)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = qr.quality_rules(both).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id][:80]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = qr.quality_rules(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert not any(r.kept for r in rows if r.quality == 0)
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) >= 0.98 * len(clean)


def test_empty_table_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (1, None, "en", 1), (None, "a " * 60, None, 2)], "doc_id long, text string, lang string, kept int")
    rows = qr.quality_rules(docs).collect()
    assert len(rows) == 3 and not any(r.kept for r in rows)
    assert qr.quality_rules(docs.limit(0)).count() == 0


def test_many_repeats_take_the_other_plan(spark, monkeypatch):
    text = " ".join(f"{i} {i + 1} {i + 2} x" for i in range(40)) * 2
    docs = spark.createDataFrame([(1, text, "en"), (2, "a b c " * 30, "en")], "doc_id long, text string, lang string")
    both = []
    for few in (0, 500):
        monkeypatch.setattr(qr, "FEW_REPEATED", few)
        both.append(sorted((r.doc_id, r.n_repeat_words) for r in qr.quality_rules(docs).collect()))
    assert both[0] == both[1] == [(1, brute(text)[4]), (2, 90)]


def test_each_language_keeps_its_reference_when_they_are_many(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(10_000, "a word " * 60, None), (10_001, "a word " * 60, "xx")], docs.schema))
    want = sorted(map(tuple, qr.quality_rules(docs).collect()))
    monkeypatch.setattr(qr, "MOST_LANGUAGES", 1)
    assert sorted(map(tuple, qr.quality_rules(docs).collect())) == want
