"""Phrase collocations from a weighted de Bruijn graph.

Texts are split into pieces at punctuation and line ends, and pieces into words. Words that occur too seldom to be
part of a candidate end a piece too; a bit map of fixed size over the hashes of the others tells them apart, and
where it errs only takes a rare word along. Every word of a piece starts a gram of up to three words. Grams of three
are the edges of a graph whose nodes are pairs of words: an edge leads from its first two words to its last two. Only
these longest grams are counted from the text; the few that a piece's end cuts short are counted with them and are
the corrections: a pair's count is what flows out of its node, over all edges, plus the pieces that end with it, and
a word's count is the flow of the pairs that start with it, plus the pieces that end with it.

Tasks number their words, fold their grams as sorted numbers, and hand them on in one compressed row for each bucket
of pairs, so the edges out of a node meet in one bucket of about BUCKET grams; those out of a pair of two very
frequent words, of which there are few, are spread over all buckets by their third word.

Edges of the least weight or more are compacted: where all flow of a node comes in on one edge and leaves on one,
the edges are joined, so that a passage that many texts share becomes one path. Links between such edges are
followed by pointer doubling, so a path takes as many rounds as its length has binary digits. Counts of words are
looked up once for each word of a path, and the pairs inside a path are known to be covered by longer phrases.

Everything is per language. Counts are folded before they are shuffled, look-ups of frequent words are salted, and
ranks are taken from the best of salted parts, so no language, word or passage has to fit one task.

Defined results: null texts count as empty, and a null language is `und`, together with rows whose language is
`und`. Repeated rows count repeatedly. Words are compared as they are after lower-casing A to Z. Empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.plans.joins import lookup_join
from semaspan.session import stored

LEAST = 10  # occurrences of a candidate
COVER = 50  # a phrase goes if a longer candidate has so many per cent of its occurrences
BEST = 2_000  # phrases of a language
BITS = 1 << 25  # of the map that tells rare words: 4 MB, whatever the input
HELD = 2_000_000  # words that a task folds before it hands their grams on, about
BUCKET = 1_000_000  # words of the corpus for each bucket, about
HOT = 256  # a word is very frequent if it makes up one of so many; there are no more of them
SEGMENT = 256  # edges of a path that are held in one row
SALTS = 64  # parts of a language that are ranked apart
SEED = 42
NARROW = 1 << 21  # three numbers below this fit 63 bits

PAIR = ["w1", "w2"]
# On UTF-8 bytes: A to Z in lower case, what ends a piece as line feed, and a tab as blank.
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
)


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of each piece of a text."""
    for piece in text.encode().translate(_PLAIN).split(b"\n"):
        words = piece.split()
        if words:
            yield words


class Numbers(dict):
    """Words numbered in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def spelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Numbers, np.ndarray]]:
    """(language, its words, their numbers in the order of the text, -1 where a piece ends), in bounded parts."""
    numbers, texts, held = defaultdict(Numbers), defaultdict(lambda: array("i")), 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            lang = lang.as_py()
            number, into = numbers[lang].__getitem__, texts[lang]
            before = len(into)
            for piece in pieces(text.as_py() or ""):
                into.extend(map(number, piece))
                into.append(-1)
            held += len(into) - before
            if held > HELD:
                yield from ((k, numbers[k], np.array(texts[k], np.int64)) for k in texts)
                numbers.clear()
                texts.clear()
                held = 0
    yield from ((k, numbers[k], np.array(texts[k], np.int64)) for k in texts)


COUNTED = "lang string, key string, n long"


def _counted(lang: str, keys: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "key", "n"]
    )


def words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, key, n): the words of each language with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, numbers, met_ in met(batches):
            yield _counted(name, list(numbers), np.bincount(met_[met_ >= 0], minlength=len(numbers)))

    return spelled(docs, text, lang).mapInArrow(count, COUNTED).groupBy("lang", "key").agg(F.sum("n").alias("n"))


def frequent_bits(counts: DataFrame, least: int) -> np.ndarray:
    """A map of BITS bits with that of each word (lang, key, n) of `least` occurrences or more set."""
    place = F.xxhash64(F.concat("key", F.lit("\n"), "lang")).bitwiseAND(F.lit(BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    places = counts.filter(F.col("n") >= least).select(F.shiftright(place, 6).alias("at"), bit.alias("bit"))
    set_ = places.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITS / 64 rows at most
    bits = np.zeros(max(1, BITS // 64), np.uint64)
    bits[set_.column("at").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return bits


def folded(grams: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of `grams` (rows, 3), numbers from -1 to size - 1, in order, with their summed counts."""
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    first, second, third = (grams[:, i] + 1 for i in range(3))
    wide = size + 1
    pair = first * wide + second
    if wide >= NARROW:  # else the three would not fit
        names, pair = np.unique(pair, return_inverse=True)
    key = pair * wide + third
    if n is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[starts], np.add.reduceat(n[order], starts)
    pair, third = np.divmod(key, wide)
    if wide >= NARROW:
        pair = names[pair]
    first, second = np.divmod(pair, wide)
    return np.stack([first, second, third], axis=1) - 1, n.astype(np.int64)


def longest(numbers: np.ndarray) -> np.ndarray:
    """The gram of up to three words from each word on; -1 behind the end of its piece."""
    after = np.concatenate([numbers, [-1, -1]])
    grams = np.stack([numbers, after[1:-1], after[2:]], axis=1)
    grams[grams[:, 1] < 0, 2] = -1
    return grams[numbers >= 0]


_CODEC = "zstd"


def packed(listed: list[bytes], grams: np.ndarray, n: np.ndarray) -> bytes:
    """Grams and counts of one bucket, with the words they hold."""
    used, numbers = np.unique(grams, return_inverse=True)
    if used[0] >= 0:
        used, numbers = np.concatenate([[-1], used]), numbers + 1
    spelled_ = b" ".join(listed[i] for i in used[1:])  # number 0 means no word
    numbers = numbers.reshape(grams.shape)
    columns = np.stack([np.diff(numbers[:, 0], prepend=0), numbers[:, 1], numbers[:, 2], n]).astype("<u4")
    # bytes of one place beside each other, as most of the high ones are zero
    plain = np.uint32(len(grams)).tobytes() + np.ascontiguousarray(columns.view(np.uint8).reshape(-1, 4).T).tobytes() + spelled_
    return len(plain).to_bytes(8, "little") + pa.compress(plain, _CODEC, asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    plain = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), _CODEC, asbytes=True)
    many = int(np.frombuffer(plain, "<u4", 1)[0])
    planes = np.frombuffer(plain, np.uint8, 16 * many, 4).reshape(4, -1)
    columns = np.ascontiguousarray(planes.T).view("<u4").reshape(4, many).astype(np.int64)
    grams = np.stack([np.cumsum(columns[0]), columns[1], columns[2]], axis=1) - 1
    return plain[4 + 16 * many :].split(), grams, columns[3]


def bucketed(docs: DataFrame, text: str, lang: str, bits: np.ndarray, hot: set[tuple[str, str]], buckets: int) -> DataFrame:
    """(lang, bucket, grams): the longest grams of frequent words, folded and packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, numbers, text_ in met(batches):
            listed, tail = list(numbers), b"\n" + name.encode()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w + tail, SEED) for w in listed), np.uint64, len(listed))
            place = hashes & np.uint64(BITS - 1)
            frequent = (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            kept = np.append(np.where(frequent, np.arange(len(listed)), -1), -1)  # the last one is behind the end
            grams, n = folded(longest(kept[text_]), None, len(listed))
            if not len(grams):
                continue
            hashes = np.append(hashes, np.uint64(0))
            heavy = np.append([(name, w.decode()) in hot for w in listed], False).astype(bool)
            mixed = hashes[grams[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + hashes[grams[:, 1]] * np.uint64(0xC2B2AE3D27D4EB4F)
            both = heavy[grams[:, 0]] & heavy[grams[:, 1]]
            mixed[both] += hashes[grams[both, 2]] * np.uint64(0x165667B19E3779F9)
            bucket = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1.0))
            parts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
            blobs = [packed(listed, grams[rows], n[rows]) for rows in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(parts), pa.string()), pa.array(bucket[order[starts]].astype(np.int32)), pa.array(blobs, pa.binary())],
                names=["lang", "bucket", "grams"],
            )

    return spelled(docs, text, lang).mapInArrow(pack, "lang string, bucket int, grams binary")


def flows(rows: DataFrame, hot: set[tuple[str, str]], least: int) -> DataFrame:
    """(lang, key, n) of the words, pairs and grams of three with `least` occurrences, from packed longest grams.

    A pair's count is the flow out of its node, a word's count the flow of its pairs; ends of pieces are among both.
    """

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, numbers, all_grams, all_n = key[0].as_py(), Numbers(), [], []
        for batch in batches:
            for blob in batch.column("grams"):
                listed, grams, n = unpacked(blob.as_py())
                number = np.append(np.fromiter(map(numbers.__getitem__, listed), np.int64, len(listed)), -1)
                all_grams.append(number[grams])
                all_n.append(n)
        grams, n = folded(np.concatenate(all_grams), np.concatenate(all_n), len(numbers))
        listed = list(numbers)
        heavy = np.array([(name, w.decode()) in hot for w in listed] + [False])

        def joined(rows: np.ndarray) -> list[bytes]:
            return [b" ".join([listed[i] for i in row]) for row in rows.tolist()]

        whole = (grams[:, 2] >= 0) & (n >= least)
        yield _counted(name, joined(grams[whole]), n[whole])
        starts = np.flatnonzero(np.concatenate([[True], (grams[1:, :2] != grams[:-1, :2]).any(1)]))
        pairs, n = grams[starts, :2], np.add.reduceat(n, starts)
        # pairs of two very frequent words have parts in other buckets
        known = (pairs[:, 1] >= 0) & ((n >= least) | (heavy[pairs[:, 0]] & heavy[pairs[:, 1]]))
        yield _counted(name, joined(pairs[known]), n[known])
        starts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        yield _counted(name, joined(pairs[starts, :1]), np.add.reduceat(n, starts))

    parts = rows.groupBy("lang", "bucket").applyInArrow(merged, COUNTED)
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, total) of all words, and (lang, w, n) of the words, pairs and grams of three with `least` occurrences."""
    known = stored(words(docs, text, lang))
    sizes = known.groupBy("lang").agg(F.sum("n").alias("total"))
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = {(r["lang"], r["key"]) for r in known.filter(F.col("n") > total / HOT).select("lang", "key").collect()}  # HOT rows at most
    rows = bucketed(docs, text, lang, frequent_bits(known, least), hot, max(1, -(-total // BUCKET)))
    return sizes, stored(flows(rows, hot, least).select("lang", F.split("key", " ").alias("w"), "n"))


def compacted(heavy: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, part, words, weight, first_flow, last_flow): unary paths of the edges, in parts of SEGMENT edges.

    heavy: (lang, w1, w2, w3, n) edges; pairs: (lang, w1, w2, n) flows of their nodes. words are the words along the
    part, weight the count of each of its edges, first_flow and last_flow the counts of its outer pairs.
    """
    node = ["lang", "u", "v"]
    flows = pairs.select("lang", F.col("w1").alias("u"), F.col("w2").alias("v"), F.col("n").alias("flow"))
    tails = heavy.select("*", F.col("w1").alias("u"), F.col("w2").alias("v")).join(flows, node).drop("u", "v").withColumnRenamed("flow", "first_flow")
    both = tails.select("*", F.col("w2").alias("u"), F.col("w3").alias("v")).join(flows, node).drop("u", "v").withColumnRenamed("flow", "last_flow")
    rows = stored(both.withColumn("id", F.monotonically_increasing_id()))
    # an edge that carries all flow of a node is the only one there
    into = rows.filter("n = last_flow").select("lang", F.col("w2").alias("u"), F.col("w3").alias("v"), F.col("id").alias("before"))
    out = rows.filter("n = first_flow").select("lang", F.col("w1").alias("u"), F.col("w2").alias("v"), "id")
    links = out.join(into, node).select("id", "before")
    state = rows.select("id").join(links, "id", "left").select(
        "id", F.coalesce("before", "id").alias("up"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("far")
    )
    state = stored(state)
    # a path starts where some piece starts or flows meet, so none is a ring and every pointer ends at a first edge
    while not state.filter("id <> up").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        moved = stored(state.join(above, "up").select("id", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("_moved")))
        done = moved.filter("_moved").isEmpty()
        state = moved.drop("_moved")
        if done:
            break
    placed = rows.join(state, "id").withColumn("part", F.floor(F.col("far") / SEGMENT))
    step = F.struct("far", "w1", "w2", "w3", "first_flow", "last_flow")
    parts = placed.groupBy("lang", F.col("up").alias("path"), "part").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.max("n").alias("weight"))
    words = F.concat(F.array(F.col("steps")[0]["w1"], F.col("steps")[0]["w2"]), F.transform("steps", lambda s: s["w3"]))
    return parts.select(
        "lang", "path", "part", words.alias("words"), "weight",
        F.col("steps")[0]["first_flow"].alias("first_flow"), F.element_at("steps", -1)["last_flow"].alias("last_flow"),
    )


def with_word_counts(paths: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `counts` of the words of each row, in their order."""
    spelled = paths.select("lang", *keys, F.posexplode("words").alias("at", "w"))
    found = lookup_join(spelled, counts.select("lang", "w", F.col("n").alias("m")), ["lang", "w"], salts=8)
    listed = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("counts"))
    return paths.join(listed, list(keys))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), (left * right).cast("decimal(38,0)"))


def triples(paths: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score) of the grams of three along the paths, cut where they score least."""
    last = F.size("words") - 3

    def gram(i: Column) -> Column:
        a = F.col("weight")
        inner_left = F.when(i == 0, F.col("first_flow")).otherwise(a)  # a pair inside a path has the path's count
        inner_right = F.when(i == last, F.col("last_flow")).otherwise(a)
        return F.struct(
            F.slice("words", i + 1, 3).alias("words"),
            F.get("counts", i).alias("l1"), inner_right.alias("r1"), inner_left.alias("l2"), F.get("counts", i + 2).alias("r2"),
        )

    grams = paths.select("lang", F.col("weight").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), last), gram)).alias("g")).select("lang", "a", "g.*")
    scored = grams.select("*", cut_score(F.col("a"), F.col("l1"), F.col("r1")).alias("s1"), cut_score(F.col("a"), F.col("l2"), F.col("r2")).alias("s2"))
    first = F.col("s1") <= F.col("s2")
    return scored.select(
        "lang", "words", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )


def covering(paths: DataFrame) -> DataFrame:
    """(lang, w1, w2, longer): the most frequent gram of three around each pair of the paths."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.get("words", i - 1).alias("w1"), F.get("words", i).alias("w2")))
    return paths.select("lang", "weight", F.explode(pairs).alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("weight").alias("longer"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two and three words that no longer one covers."""
    sizes, counts = counted(docs, text, lang, least)

    def of(size: int) -> DataFrame:
        return counts.filter(F.size("w") == size).select("lang", *[F.col("w")[i].alias(f"w{i + 1}") for i in range(size)], "n")

    frequent, pairs = of(1).withColumnRenamed("w1", "w"), of(2)
    paths = stored(with_word_counts(compacted(of(3), pairs), frequent, ["path", "part"]).select("lang", "words", "weight", "first_flow", "last_flow", "counts"))

    left_over = pairs.join(covering(paths), ["lang", *PAIR], "left").filter(100 * F.coalesce("longer", F.lit(0)) < cover * F.col("n"))
    known = left_over.select("lang", F.col("n").alias("a"), *PAIR)
    for w, name in zip(PAIR, "lr"):
        known = lookup_join(known, frequent.select("lang", F.col("w").alias(w), F.col("n").alias(name)), ["lang", w], salts=8)
    two = known.select("lang", F.array(*PAIR).alias("words"), "a", "l", "r", cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    found = two.unionByName(triples(paths))
    return lookup_join(found, sizes, "lang", salts=8).select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")


def best(found: DataFrame, most: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    parts = parts.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= most)
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
