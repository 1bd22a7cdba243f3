"""SimHash near-duplicates with vantage-point trees.

A text's fingerprint has a bit set if more than half of its shingles' 64-bit hashes have it set. Equal
fingerprints are folded first, so copies cost one row. The different ones are parted twice. First by equal
blocks of bits: of five blocks, a difference of four bits leaves one equal, so linked fingerprints meet in the
part that this block's first bits name, and each fingerprint stands in five parts however many there are.
A part that still holds more than a shard may is then split by a vantage-point tree, by the Hamming distance
from a pivot at each node: each fingerprint has one home shard, and visits all shards that a ball of the
linking radius around it reaches, which the triangle bounds at the nodes tell. Inside a shard a tree of its own
is searched by the visitors, pruned by the same bounds, so that all links are found. A shard gives back a
star for each of its components, and stars are joined into components.

Only the upper tree's pivots, fitted on a bounded sample, are sent to all tasks, and only if some part is too large.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like
any other. Rows with equal texts, repeated doc_ids too, are in one component. The component of rows that
have no doc_id at all is null. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.llm.components import connected
from semaspan.llm.workers import tidied
from semaspan.session import stored

WORDS, BITS = 4, 4  # words of a shingle, and how many bits linked fingerprints may differ in
HASH_SEED = 42
SAMPLE = 4_096  # fingerprints that the pivots are fitted on, at most
SHARD = 400_000  # different fingerprints of a part above which a tree splits it
HOME = 16_384  # different fingerprints that a part is meant to hold, as long as blocks have bits enough
SMALL = 20_000  # different fingerprints that stay in one part
LEAF = 192  # fingerprints of a shard that are compared one by one
PAIRS_AT_ONCE = 2_000_000
HASHES_AT_ONCE = 65_536


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of `words` words, lower-cased from A to Z and joined by spaces."""
    found = text.encode().lower().split()  # on bytes, just the six ASCII blanks part words
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(HASH_SEED)), np.uint64, n)


def fingerprint_of(text: str, words: int = WORDS) -> int:
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column | str, words: int = WORDS) -> Column:
    """The fingerprint of each text, as a signed 64-bit number."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidied(batches, "simhash"):
            yield pa.array([fingerprint_of(t.as_py() or "", words) for t in batch], pa.int64())

    return prints(text)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Node:
    """A pivot and the distance up to which fingerprints lie inside; nodes are numbered like a heap, from 1."""

    def __init__(self, points: np.ndarray, depth: int, number: int = 1):
        self.number, self.leaf = number, not depth
        if depth:
            self.pivot = points[len(points) // 2] if len(points) else np.uint64(0)
            far = hamming(points, self.pivot)
            self.radius = int(np.median(far)) if len(points) else 32
            self.inside = Node(points[far <= self.radius], depth - 1, 2 * number)
            self.outside = Node(points[far > self.radius], depth - 1, 2 * number + 1)

    def reached(self, points: np.ndarray, rows: np.ndarray, bits: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, rows) for the nodes `depth` levels down that a ball of `bits` around a row reaches; 0 bits give its home."""
        if self.leaf or not depth:
            yield self.number, rows
            return
        far = hamming(points[rows], self.pivot)
        yield from self.inside.reached(points, rows[far <= self.radius + bits], bits, depth - 1)
        yield from self.outside.reached(points, rows[far + bits > self.radius], bits, depth - 1)


def upper_tree(prints: DataFrame, depth: int) -> Node:
    """The upper tree over the rows with the smallest hashes of their fingerprints."""
    sample = [r["fp"] for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    return Node(np.array(sample, np.int64).view(np.uint64), depth)


def block_masks(n: int, bits: int) -> list[int]:
    """Masks of bits; fingerprints at most `bits` apart agree under one of them at least.

    Of bits + e blocks, e are equal, so a mask takes the first bits of e blocks, as many as leave about HOME of
    `n` fingerprints in a part. One equal block does, with bits + 1 masks, until whole blocks leave more than a
    shard: four bits have five masks up to some 10^9 fingerprints, and fifteen of two blocks beyond.
    """
    if n <= SMALL:
        return [0]
    for equal in range(1, 5):
        width = 64 // (bits + equal)
        taken = min(width, int(np.ceil(np.log2(max(n / HOME, 1)) / equal)))
        if n / 2.0 ** (taken * equal) <= SHARD:
            break
    blocks = [((1 << taken) - 1) << (i * width) for i in range(bits + equal)]
    return sorted({sum(chosen) for chosen in combinations(blocks, equal)})


def neighbours(homes: np.ndarray, guests: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (home, guest) at most `bits` apart, block by block, by a vantage-point tree over the homes."""
    stack = [(np.arange(len(homes)), np.arange(len(guests)))]
    while stack:
        at, asked = stack.pop()
        if not len(at) or not len(asked):
            continue
        pivot = homes[at[len(at) // 2]]
        far = hamming(homes[at], pivot)
        radius = int(np.median(far))
        inside = far <= radius
        if len(at) <= LEAF or inside.all():
            for i in range(0, len(asked), 4096):
                part = asked[i : i + 4096]
                for j in range(0, len(at), 512):
                    block = at[j : j + 512]
                    a, b = np.nonzero(np.bitwise_count(homes[block][:, None] ^ guests[part][None, :]) <= bits)
                    if len(a):
                        yield block[a], part[b]
            continue
        away = hamming(guests[asked], pivot)
        stack.append((at[inside], asked[away <= radius + bits]))
        stack.append((at[~inside], asked[away + bits > radius]))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining rows a[i] and b[i]; a label is the smallest row of its component."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(label[label], label):
            label = label[label]


def link_shard(bits: int):
    def link(shard: pa.Table) -> pa.Table:
        prints = shard.column("fp").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(prints.view(np.int64), kind="stable")  # so that the smallest row is the smallest fingerprint
        prints, home = prints[order], home[order]
        label, rows = np.arange(len(prints)), np.flatnonzero(home)
        a, b, held = [], [], 0
        for i, j in neighbours(prints[rows], prints, bits):
            a.append(rows[i])
            b.append(j)
            held += len(i)
            if held > PAIRS_AT_ONCE:
                label, a, b, held = merged(label, np.concatenate(a), np.concatenate(b)), [], [], 0
        if a:
            label = merged(label, np.concatenate(a), np.concatenate(b))
        linked = np.flatnonzero(label != np.arange(len(label)))
        signed = prints.view(np.int64)
        return pa.table({"a": pa.array(signed[linked]), "b": pa.array(signed[label[linked]])})

    return link


def parted(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(mask, part, shard, fp, home): the different fingerprints `prints` (fp) in all shards they are compared in."""
    masks = block_masks(prints.count(), bits)

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    part = F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("part")) for i, m in enumerate(masks)
    ])).alias("_p")
    parts = prints.select("fp", part).select("_p.mask", "_p.part", "fp")
    sizes = parts.groupBy("mask", "part").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD)
    depth = F.ceil(F.log2(F.col("n") / SHARD)).cast("int").alias("depth")
    large = stored(sizes.select("mask", "part", depth))
    deepest = large.agg(F.max("depth")).first()[0]
    whole = parts.select("mask", "part", F.lit(1).cast("long").alias("shard"), "fp", F.lit(True).alias("home"))
    if deepest is None:
        return whole
    tree = prints.sparkSession.sparkContext.broadcast(upper_tree(prints, min(deepest, int(np.log2(SAMPLE)))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            depths = batch.column("depth").to_numpy()
            for depth in np.unique(depths).tolist():
                rows = np.flatnonzero(depths == depth)
                home = np.zeros(len(points), np.int64)
                for shard, at in tree.value.reached(points, rows, 0, depth):
                    home[at] = shard
                for shard, at in tree.value.reached(points, rows, bits, depth):
                    if len(at):
                        taken = batch.take(pa.array(at))
                        columns = [taken["mask"], taken["part"], pa.array(np.full(len(at), shard)), taken["fp"], pa.array(home[at] == shard)]
                        yield pa.RecordBatch.from_arrays(columns, ["mask", "part", "shard", "fp", "home"])

    split = parts.join(large, ["mask", "part"]).mapInArrow(sent, "mask int, part long, shard long, fp long, home boolean")
    return whole.join(large, ["mask", "part"], "left_anti").unionByName(split)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): stars that connect the different fingerprints `prints` (fp) at most `bits` apart."""
    return parted(prints, bits).groupBy("mask", "part", "shard").applyInArrow(link_shard(bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text)."""
    rows = stored(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(prints, bits))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
