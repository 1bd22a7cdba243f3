import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline

from semaspan.llm import bpe, workers
from semaspan.llm import near_copies as nc
from semaspan.llm.queries import RANKS


def jaccard(a, b):
    a, b = (set(zip(*[t.lower().split()[i:] for i in range(5)])) for t in (a, b))
    return len(a & b) / len(a | b)


def planted(rng, n):
    """Texts with copies of which a few words are changed, about the bound of 0.8."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(200)]
        texts.append(" ".join(words))
        for changes in (1, 3, 5, 12):
            other = list(words)
            for at in rng.sample(range(200), changes):
                other[at] = word()
            texts.append(" ".join(other))
    return texts


def want(texts):
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_stage_drops_planted_near_copies(spark):
    texts = planted(random.Random(3), 20)
    root = want(texts)
    assert 30 < len(set(root)) < 80
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_members_that_only_link_to_others_than_the_first(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    texts = []
    for step in range(8):  # a chain: each text is near the next one, not near the first
        texts.append(" ".join(words))
        for at in range(40 * step, 40 * step + 20):
            words[at % 300] = "".join(rng.choices("klmnop", k=6))
    assert jaccard(texts[0], texts[7]) < 0.5
    docs = spark.createDataFrame(list(enumerate(texts)) + [(20, None), (21, " "), (22, texts[3]), (22, texts[3])], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in nc.near_copies(docs).collect()}
    assert got == {(i, 0) for i in (*range(8), 22)} | {(20, 20), (21, 20)}
    assert nc.near_copies(docs.limit(0)).count() == 0


def test_large_buckets_move_no_pairs_and_lose_none(spark, monkeypatch):
    """Copies a little less alike than 0.8, which share bands: stars only come out, block by block."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    words, texts = [word() for _ in range(200)], []
    for changes in [4] * 90 + [2] * 30:
        other = list(words)
        for at in rng.sample(range(200), changes):
            other[at] = word()
        texts.append(" ".join(other))
    monkeypatch.setattr(nc, "BLOCK", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    root = want(texts)
    assert got == dict(enumerate(root)) and len(set(root)) > 10
    sets = [nc.shingle_set(t) for t in texts]
    everyone = np.arange(len(sets))
    counts = nc.shared_counts(sets, everyone, everyone[:7])
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(7, 120, 11) for j in range(7))  # a set beside itself counts what others share
    rows = pa.table({"left": pa.array([None] * 120, pa.bool_()), "fp": everyone, "root": everyone, "set": [x.tobytes() for x in sets]})
    assert len(nc.stars_of_blocks(rows)) == 120 - len(set(root))


def test_sets_of_a_batch_are_not_held_at_once():
    texts = pa.array([f"{i} a b c d e f" for i in range(1_300)])
    for udf in (nc._signed, nc._named_set):
        parts = list(udf.func(iter([texts])))
        assert len(parts) > 2 and sum(map(len, parts)) == len(texts)
        assert max(map(len, parts)) <= nc.TEXTS_AT_ONCE


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Without MinHash bands the stage still drops what SimHash links, if it is alike; what is not alike stays."""
    calls, original = [], pipeline.simhash.near_duplicates
    monkeypatch.setattr(pipeline.simhash, "near_duplicates", lambda *a: calls.append(a) or original(*a))
    texts = planted(random.Random(3), 20)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    linked = {r.doc_id: r.component_id for r in original(docs).collect()}
    near = {i for i in linked if linked[i] != i and jaccard(texts[i], texts[linked[i]]) >= 0.8}
    assert near
    monkeypatch.setattr(nc, "band_members", lambda sets, members=nc.band_members: members(sets).filter("band < 0"))
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert calls and not kept & near and kept >= set(want(texts))


def test_proposed_candidates_are_compared_exactly(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    other = ["".join(rng.choices("klmnop", k=6)) for _ in range(200)]
    texts = [" ".join(other), " ".join(words), " ".join([*words[:199], "x"]), None, " ".join(other)]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4]), (None, texts[2])], "doc_id long, text string")
    proposed = docs.select("doc_id", (docs["doc_id"] * 0).alias("key"))
    got = {(r.doc_id, r.component_id) for r in nc.near_copies(docs, proposed).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (None, 1), (3, 3), (4, 0)}


def test_workers_forget_other_operators_and_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda back=workers.give_back: calls.append(back()))
    table = bpe.spellings(RANKS)
    assert list(workers.tidied(iter([1, 2]), "bpe")) == [1, 2] and bpe.spellings(RANKS) is table and len(calls) == 2
    for udf in (nc._signed, nc._named_set):
        assert sum(map(len, udf.func(iter([pa.array(["a b c"] * 7)])))) == 7
    assert len(calls) == 6 and bpe.spellings.cache_info().currsize == 0
    assert bpe.spellings(RANKS) == table
