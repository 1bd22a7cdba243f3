import random

import numpy as np
import pytest

from semaspan.llm import substrings as sub
from semaspan.llm.fm_index import FMIndex


def brute(texts, width=35):
    places = {}
    split = [t.encode().split() if t else [] for t in texts]
    for d, words in enumerate(split):
        for i in range(len(words) - width + 1):
            places.setdefault(b" ".join(words[i : i + width]), []).append((d, i))
    covered = [set() for _ in split]
    for where in places.values():
        if len(where) > 1:
            for d, i in where:
                covered[d].update(range(i, i + width))
    return [(len(w), len(c), b" ".join(x for i, x in enumerate(w) if i not in c).decode()) for w, c in zip(split, covered)]


def compare(spark, texts, **parameters):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, sum(x["to"] - x["from"] for x in r.removed), r.kept) for r in sub.without_repeats(docs, **parameters).collect()}
    want = brute(texts, parameters.get("width", 35))
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, i


def test_index_counts_patterns():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = FMIndex(text, 5, 12)
    flat = "".join(map(str, text))
    for length in (1, 3, 6, 12):
        first = np.arange(0, 380 - length, 7)
        for least in (1, 2, 3):
            back = index.reach(text, first, first + length - 1, least)
            for a, b, e in zip(first, back, first + length):
                times = lambda s: sum(flat.startswith(s, i) for i in range(len(flat)))
                assert b == e or times(flat[b:e]) >= least
                assert b == a or times(flat[b - 1 : e]) < least


@pytest.mark.parametrize("width, kgram, vocabulary", [(6, 2, 3), (35, 8, 400)])
def test_against_brute_force(spark, width, kgram, vocabulary):
    rng = random.Random(width)
    words = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6 * width))) for _ in range(40)]
    passage = " ".join(rng.choices(words, k=2 * width))
    for i in range(0, 40, 3):  # shared passages, whole and in part, and copies
        part = passage.split()[rng.randint(0, width) : rng.randint(width, 2 * width)]
        texts[i] = texts[i] + "\n\t" + " ".join(part) + " " + texts[i][:50]
    texts += [texts[3], texts[3], "a " * 4 * width, " ".join("ab"[i % 2] for i in range(3 * width)), "", None, "\x0b one", " ".join(words[:1] * width)]
    compare(spark, texts, width=width, kgram=kgram)


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    compare(spark, texts)


def test_long_text_in_pieces(spark, monkeypatch):
    text = "some words and áé " * 50 + "x" * 300 + " tail"
    whole = sub.word_hashes(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(sub, "PIECE", 100)
    assert np.array_equal(whole, sub.word_hashes(np.frombuffer(text.encode(), np.uint8))) and len(whole) == len(text.split())


def test_repeated_rows_nulls_and_empty_table(spark):
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (None, text[:-2], "k"), (2, None, None)], "doc_id long, text string, key string")
    got = sorted((r.n_words, sum(x["to"] - x["from"] for x in r.removed)) for r in sub.without_repeats(docs).collect())
    assert got == [(0, 0), (39, 39), (40, 40), (40, 40)]
    assert sub.without_repeats(docs.limit(0)).count() == 0
