import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaspan.llm import simhash as sh
from semaspan.llm.components import connected


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text, words=4):
    import xxhash

    found = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for blank in "\t\n\x0b\x0c\r":
        found = found.replace(blank, " ")
    found = [w for w in found.split(" ") if w]
    parts = [found[i : i + words] for i in range(len(found) - words + 1)] or ([found] if found else [])
    hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_linked_fingerprints_agree_under_a_mask():
    rng = random.Random(1)
    for n, bits, masks in [(100, 4, 1), (10**6, 4, 5), (10**9, 4, 5), (10**10, 4, 15), (10**6, 8, 9)]:
        found = sh.block_masks(n, bits)
        assert len(found) == masks and n / 2 ** min(m.bit_count() for m in found) <= sh.SHARD
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), bits))
            assert any(change & m == 0 for m in found)


def test_shards_are_bounded_and_copies_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(sh, "SMALL", 100)
    monkeypatch.setattr(sh, "HOME", 64)
    monkeypatch.setattr(sh, "SHARD", 150)
    rng = random.Random(2)
    for n in (1_000, 8_000):
        frame = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(n)], "fp long").distinct()
        shards = [r["count"] for r in sh.parted(frame).groupBy("mask", "part", "shard").count().collect()]
        assert sum(shards) == 5 * n and max(shards) <= 150
    # fingerprints that agree in one block make a part too large, which the tree splits
    hot = spark.createDataFrame([(rng.getrandbits(50) << 13,) for _ in range(3_000)], "fp long").distinct()
    split = sh.parted(hot).filter("part = 0 AND mask = 0").groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).collect()
    assert len(split) > 16 and sum(r.homes for r in split) == 3_000 and max(r.homes for r in split) <= 450


def test_fingerprints(spark):
    texts = ["", " \n", "One", "one TWO three", "a b c d", "É é a b c\x0bd e f g h", "x " * 500]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    for text in texts:
        assert sh.fingerprint_of(text) & (2**64 - 1) == slow_fingerprint(text)
    one = spark.createDataFrame([("ab cd ef gh",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert int(sh.shingle_hashes("ab cd ef gh")[0]) == one % 2**64  # Spark's own hash has the same seed


@pytest.mark.parametrize("small, home, shard, leaf", [(20_000, 16_384, 400_000, 192), (50, 60, 400_000, 4), (50, 60, 40, 5), (50, 500, 500, 6), (50, 1, 0.5, 7)])
def test_components_against_all_pairs(spark, monkeypatch, small, home, shard, leaf):
    monkeypatch.setattr(sh, "SMALL", small)
    monkeypatch.setattr(sh, "HOME", home)
    monkeypatch.setattr(sh, "SHARD", shard)
    monkeypatch.setattr(sh, "LEAF", leaf)
    rng = random.Random(leaf)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(500):  # chains and clusters
        fp = rng.choice(prints)
        for _ in range(rng.randint(1, 6)):
            fp ^= 1 << rng.randrange(64)
        prints.append(fp)
    prints = sorted(set(prints))
    a = np.array(prints, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, 1))
    signed = a.view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    got = {r.node: r.root for r in connected(sh.links(frame)).collect()}
    want = roots(len(a), near.tolist())
    groups, found = {}, {}
    for i, fp in enumerate(signed):
        groups.setdefault(want[i], set()).add(fp)
        found.setdefault(got.get(fp, fp), set()).add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    assert all(root == min(members) for root, members in found.items())


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r.node, r.root) for r in connected(edges).collect()} == {(i, 0) for i in range(1, 301)}
    assert connected(edges.limit(0)).count() == 0


def test_documents_nulls_and_repeats(spark):
    rows = [(5, None), (3, ""), (9, "same words in here"), (9, "same words in here"), (7, "Same WORDS in here"), (1, "other text"), (None, "alone and nameless")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in sh.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 7), (9, 7), (7, 7), (1, 1), (0, None)], key=str)
    assert sh.near_duplicates(docs.limit(0)).count() == 0
    assert docs.limit(1).select(sh.hexadecimal(F.lit(-1).cast("long")), sh.hexadecimal(F.lit(10).cast("long"))).first() == ("f" * 16, "000000000000000a")
