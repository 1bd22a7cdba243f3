"""Near copies by exact Jaccard similarity of word shingles, with MinHash bands as candidate search.

Texts with equal sets of shingles are folded first, so copies cost one row. Each different set gets BANDS keys
of BAND_ROWS minima; sets that share a key are candidates, and so are those that the caller proposes, as one more
band. Every candidate is compared exactly with the smallest of its bucket, which joins most of a large group. Buckets whose members are still in different components
are dealt to blocks of bounded size, and each block meets each other block of its bucket: there all pairs are
counted by products of incidence matrices, and only the stars of what they join come out. So no pair of a bucket is
left out, and the rows that move grow with the members, times the blocks of a bucket beyond BLOCK members. A pair of
similarity 0.8 shares no key once in 190,000 cases, a more similar one more seldom.

Defined results: a null text counts as empty, and texts without words have equal (empty) sets. The component
of rows that have no doc_id at all is null. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspan.llm.components import connected
from semaspan.llm.simhash import merged, shingle_hashes
from semaspan.llm.workers import tidied
from semaspan.session import stored

WORDS = 5  # words of a shingle
NUMERATOR, DENOMINATOR = 4, 5  # similarity from which texts are linked
BANDS, BAND_ROWS = 40, 6
HASHES_AT_ONCE = 512
TEXTS_AT_ONCE = 500  # whose sets a worker holds
BLOCK = 2_048  # sets that a task compares among each other, at most about
BLOCK_SHINGLES = 4_000_000  # and shingles in them
COLUMNS_AT_ONCE = 1_024  # of the incidence matrices
ROWS_AT_ONCE = 128  # of a block's counts that are compared with the bound

_RANDOM = np.random.default_rng(17)
_FACTORS = _RANDOM.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)
_MIX = _RANDOM.integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, WORDS))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: a hash of its minima, each over another permutation of the hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[None, at : at + HASHES_AT_ONCE] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(least, part.min(1), out=least)
    return (least.reshape(BANDS, BAND_ROWS) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def name_of(hashes: np.ndarray) -> bytes:
    """128 bits, so that no two different sets of a very large corpus share a name."""
    return xxhash.xxh128_digest(hashes.tobytes())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets, each in order, reaches the bound."""
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches in parts of few rows: sets of shingles are larger than their texts, and a worker keeps the memory of its largest part."""
    return (batch.slice(i, TEXTS_AT_ONCE) for batch in tidied(batches, "near_copies") for i in range(0, len(batch), TEXTS_AT_ONCE))


@F.arrow_udf(T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())]))
def _signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in parts(batches):
        sets = [shingle_set(t.as_py() or "") for t in batch]
        names = [name_of(s) for s in sets]
        keys = [band_keys(s) for s in sets]
        bands = pa.ListArray.from_arrays(
            pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
        )
        sizes = pa.array([len(x) for x in sets], pa.int64())
        yield pa.StructArray.from_arrays([pa.array(names, pa.binary()), bands, sizes], names=["fp", "bands", "size"])


@F.arrow_udf(T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("set", T.BinaryType())]))
def _named_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts(batches):
        sets = [shingle_set(t.as_py() or "") for t in texts]
        names, found = pa.array([name_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.StructArray.from_arrays([names, found], names=["fp", "set"])


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b)], pa.bool_())


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many hashes each set of `rows` shares with each set of `columns`, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, number, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1  # a hash of one set only is shared with none
    keep = times[number] > 1
    owner, number = owner[keep], common[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    shared = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(number, [at, at + COLUMNS_AT_ONCE])
        held = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        held[owner[a:b], number[a:b] - at] = 1
        shared += held[rows] @ held[columns].T
    return shared  # whole numbers below 2 ** 24 are exact


def stars_of_blocks(rows: pa.Table) -> pa.Table:
    """(a, b): stars of what the near pairs between two blocks of a bucket join, or inside one block.

    rows: (left, fp, root, set); with two blocks, `left` tells them apart, inside one it is null.
    """
    fp, root = rows.column("fp").to_numpy(), rows.column("root").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
    side = rows.column("left").to_pylist()
    everyone = np.arange(len(fp))
    one = side[0] is None
    left, right = (everyone, everyone) if one else (np.flatnonzero(side), np.flatnonzero(~np.array(side, bool)))
    shared, size = shared_counts(sets, left, right), np.array([len(x) for x in sets])
    label = everyone.copy()
    for at in range(0, len(left), ROWS_AT_ONCE):  # few rows at once, as a task has little memory beside its executor's
        some, part = left[at : at + ROWS_AT_ONCE], shared[at : at + ROWS_AT_ONCE].astype(np.int64)
        near = DENOMINATOR * part >= NUMERATOR * (size[some][:, None] + size[right][None, :] - part)
        i, j = np.nonzero(near & (root[some][:, None] != root[right][None, :]))
        label = merged(label, some[i], right[j])
    linked = np.flatnonzero(label != everyone)
    return pa.table({"a": pa.array(fp[linked]), "b": pa.array(fp[label[linked]])})


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; a is the first of its bucket, and so of many pairs."""
    with_b = pairs.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", _similar("set_a", "set_b").alias("near")).filter("near").select("a", "b")


def _linked_in_blocks(members: DataFrame, apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that join what is near in the buckets `apart` (band, key, n, shingles) of `members` (band, key, fp, root)."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(apart.select("band", "key", blocks.alias("blocks")), ["band", "key"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block, other = F.col("block"), F.col("other")
    met = dealt.select(
        "band", "key", F.least(block, other).alias("i"), F.greatest(block, other).alias("j"), "fp", "root",
        F.when(block != other, block < other).alias("left"),
    )
    whole = met.join(sets, "fp").select("band", "key", "i", "j", "left", "fp", "root", "set")
    return whole.groupBy("band", "key", "i", "j").applyInArrow(lambda rows: stars_of_blocks(rows), "a long, b long").distinct()


def band_members(sets: DataFrame) -> DataFrame:
    """(fp, band, key): the buckets of each set."""
    return sets.select("fp", F.posexplode("bands").alias("band", "key"))


def proposed_members(rows: DataFrame, sets: DataFrame, proposed: DataFrame) -> DataFrame:
    """(fp, band, key): the sets of rows that share a key of `proposed` (doc_id, key), as the band after the last."""
    keys = proposed.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    ids = rows.select("doc_id", F.col("fp").alias("name")).distinct()
    named = ids.join(keys, ids["doc_id"].eqNullSafe(keys["_id"])).select("name", "_key").distinct()
    return named.join(sets.select("name", "fp"), "name").select("fp", F.lit(BANDS).alias("band"), F.col("_key").alias("key"))


def near_copies(docs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text), doc_id of any type that has an order.

    proposed: (doc_id, key) of another search, key a long; texts of rows with one key are compared as those of a bucket are.
    """
    signed = docs.select("doc_id", _signed(F.col("text")).alias("s")).select("doc_id", "s.fp", "s.bands", "s.size")
    rows = stored(signed)
    # from here on a set is known by a number of its own, which is shorter than its name and as exact
    sets = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("bands").alias("bands"), F.min("size").alias("size"))
    sets = stored(sets.withColumnRenamed("fp", "name").withColumn("fp", F.monotonically_increasing_id()))
    members = band_members(sets)
    if proposed is not None:
        members = members.unionByName(proposed_members(rows, sets, proposed))
    # buckets of one set need no comparison
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("fp").alias("first")).filter("n > 1").drop("n")
    members = stored(members.join(shared, ["band", "key"]))
    wanted = sets.join(members.select("fp").distinct(), "fp", "left_semi")
    ids = wanted.select("least").distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["least"]), "left_semi")
    spelled = texts.select(_named_set("text").alias("s")).select(F.col("s.fp").alias("name"), "s.set")
    of = stored(spelled.join(wanted.select("name", "fp"), "name").dropDuplicates(["fp"]).select("fp", "set"))  # a doc_id may have several texts
    first = stored(_linked(members.filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct(), of))
    roots = connected(first)
    named = members.join(roots, members["fp"] == roots["node"], "left").select("band", "key", "fp", F.coalesce("root", "fp").alias("root"))
    apart = named.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key")
    named = stored(named.join(apart, ["band", "key"], "left_semi").join(sets.select("fp", "size"), "fp"))
    buckets = named.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    roots = connected(first.unionByName(_linked_in_blocks(named.drop("size"), buckets, of)))
    rooted = sets.join(roots, sets["fp"] == roots["node"], "left").select("name", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(smallest, "root").select(F.col("name").alias("fp"), "component_id")
    return rows.select("doc_id", "fp").join(found, "fp").select("doc_id", "fp", "component_id")
