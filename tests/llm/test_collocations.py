import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semaspan.llm import collocations as co


def want(docs, least=10, cover=50, most=2_000):
    """Plain counting. docs: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang in n:
        known = [p[1:] for p in f if p[0] == lang and len(p) > 2 and f[p] >= least]
        longer = Counter()
        for p in known:
            for q in ((p[:2], p[1:]) if len(p) == 3 else ()):
                longer[q] = max(longer[q], f[(lang, *p)])
        rows = []
        for p in known:
            a = f[(lang, *p)]
            if len(p) == 2 and 100 * longer[p] >= cover * a:
                continue
            cuts = [(10**6 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[(lang, *p[:k])], f[(lang, *p[k:])]))
        out |= {(lang, r, p.decode(), -a, l_, r_, n[lang], -s) for r, (s, a, p, l_, r_) in enumerate(sorted(rows)[:most], 1)}
    return out


def got(spark, docs):
    df = spark.createDataFrame([(t, la, 1, "w") for t, la in docs], "text string, lang string, n int, phrase string")
    return {tuple(r) for r in co.best(co.collocations(df)).collect()}


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_against_plain_counting(spark, monkeypatch, bits):
    monkeypatch.setattr(co, "SEGMENT", 4)  # paths of several parts
    monkeypatch.setattr(co, "HELD", 500)  # many hand-overs
    monkeypatch.setattr(co, "BUCKET", 2_000)
    monkeypatch.setattr(co, "NARROW", 1 << 21 if bits == 64 else 4)  # both forms of folding
    monkeypatch.setattr(co, "BITS", bits)  # a map that lets many rare words pass, and a fine one
    rng = random.Random(2)
    words = ["of", "the", "a", "ist", "Ähre", "ähre", "Of", " ", "x-y", "'t"]
    passage = " ".join(f"p{i}" for i in range(45))
    docs = [(" ".join(rng.choices(words, k=rng.randrange(40))).replace(" a ", ", "), rng.choice(["en", "de", None])) for _ in range(300)]
    docs += [(f"{rng.choice(words)} {passage} {rng.choice(words)}", "en") for _ in range(12)] + [(passage + ".", "de")] * 11
    docs += [("ha " * 5_000, "en"), ("one two. One\ttwo;one two\x0bone two " * 4, None), ("", "en"), (None, "en"), (None, None), (" \t.,", "xx")]
    docs += [(" ".join(rng.choices([f"rare{i}" for i in range(99)] + ["of"] * 60, k=2_000)), "en")]
    docs += [("r1 r2 r3 " * 30, "und")]  # a ring, but for its ends
    assert got(spark, docs) == want(docs)


def test_paths_join_edges_that_carry_all_flow(spark):
    docs = [("a b c d e f g", "en")] * 12 + [("z c d e y", "en")] * 10
    df = spark.createDataFrame(docs, "text string, lang string")
    sizes, counts = co.counted(df)
    assert [tuple(r) for r in sizes.collect()] == [("en", 12 * 7 + 10 * 5)]
    w = F.col("w")
    pairs = counts.filter(F.size(w) == 2).select("lang", w[0].alias("w1"), w[1].alias("w2"), "n")
    heavy = counts.filter(F.size(w) == 3).select("lang", w[0].alias("w1"), w[1].alias("w2"), w[2].alias("w3"), "n")
    paths = co.compacted(heavy, pairs).collect()
    assert {(" ".join(r.words), r.weight, r.first_flow, r.last_flow) for r in paths} == {
        ("a b c d", 12, 12, 22), ("z c d", 10, 10, 22), ("c d e", 22, 22, 22), ("d e f g", 12, 22, 12), ("d e y", 10, 22, 10),
    }
    # flows are the counts of the shorter phrases, piece ends included
    of = {" ".join(r.w): r.n for r in counts.collect()}
    assert of["c d"] == 22 and of["f g"] == 12 and of["g"] == 12 and of["y"] == 10
    assert {k: n for k, n in of.items() if " " not in k} == {"a": 12, "b": 12, "c": 22, "d": 22, "e": 22, "f": 12, "g": 12, "z": 10, "y": 10}


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [(3_000_000_019, 3_000_000_021, 3_000_000_037), (10**14, 10**14, 10**14 + 1)]
    for _ in range(200):
        a = rng.randrange(10, 10**13)
        rows.append((a, rng.randrange(a, 10 * a), rng.randrange(a, 100 * a)))
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", co.cut_score(F.col("a"), F.col("l"), F.col("r")))
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in df.collect())
    assert dict(df.dtypes)["s"] == "bigint"


def test_empty_table(spark):
    assert got(spark, []) == set() and got(spark, [(None, None)]) == set()


@pytest.mark.parametrize("narrow", [4, 1 << 21])
def test_folding_and_packing(monkeypatch, narrow):
    monkeypatch.setattr(co, "NARROW", narrow)
    monkeypatch.setattr(co, "HELD", 20)
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randrange(12))) + rng.choice([".", " ", "\n"]) + " x y" for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None], "lang": ["en"] * 51})
    want_, got_, parts = Counter(), Counter(), 0
    for text in texts:
        for piece in co.pieces(text):
            want_.update(tuple(piece[i : i + 3]) for i in range(len(piece)))
    for _, numbers, met in co.met([batch]):
        parts += 1
        grams, n = co.folded(co.longest(met), None, len(numbers))
        if not len(grams):
            continue
        again, m = co.folded(np.concatenate([grams, grams]), np.concatenate([n, n]), len(numbers))
        assert again.tolist() == grams.tolist() and m.tolist() == (2 * n).tolist()
        listed, back, m = co.unpacked(co.packed(list(numbers), grams, n))
        for row, k in zip(back.tolist(), m.tolist()):
            got_[tuple(listed[i] for i in row if i >= 0)] += k
    assert got_ == want_ and parts > 10
