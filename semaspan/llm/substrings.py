"""Substring dedup: words covered by windows of text that occur anywhere else too, found by FM-indexes.

Every window of `width` words has a minimizer, the smallest hash among its runs of KGRAM words. Neighbouring
windows with the same one form a segment, and equal windows have equal minimizers, so the segments of one
minimizer can be indexed apart from all others. Minimizers that stand in one place only cannot belong to a
repeated window; their segments go no further. The rest are cut out of the texts, equal segments are folded,
and each shard of minimizers builds a compressed index of its segments and streams them through it: backward
search gives how far each piece of text is matched twice or more. Hashes only choose where to look; whether
two windows are equal is decided by the index on the words themselves.

Rows are told apart by doc_id and text, so repeated rows are copies of each other. Defined results: a null or
empty text has no words. Rows of an empty table give none. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaspan.llm.fm_index import FMIndex
from semaspan.session import stored

WIDTH = 35
KGRAM = 8
SHARD_WORDS = 1_500_000  # words of folded segments in one index, about
PIECE = 2_000_000  # bytes hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of them."""
    size = max(PIECE + 1, n)
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (BASE, inverse))
    return _POWERS[size]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, piece by piece."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):  # pieces end at a blank; a longer word makes a longer piece
            blanks = np.flatnonzero(BLANK[data[at:end]])
            more = np.flatnonzero(BLANK[data[end:]]) if not len(blanks) else None
            end = at + int(blanks[-1]) + 1 if len(blanks) else (end + int(more[0]) + 1 if len(more) else len(data))
        part = data[at:end]
        blank = np.concatenate([[True], BLANK[part], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
        out.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def segments_of(words: np.ndarray, width: int, kgram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer, places) of the segments of a text, given its words' hashes.

    places is 2 if the minimizer stands in more than one place of the segment, so that a segment can hold a
    window twice, else 1.
    """
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(len(words) - kgram + 1, np.uint64)
    for i in range(kgram):
        grams = grams * BASE + words[i : i + len(grams)]
    grams = mixed(grams)
    least, covered, runs = grams, 1, width - kgram + 1
    while covered < runs:
        step = min(covered, runs - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    begin = np.flatnonzero(fresh)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    start = np.flatnonzero(place % runs == 0)  # a run of one minimizer is cut after so many windows
    windows = np.diff(np.append(start, n))
    key = least[start]
    near = np.arange(runs)
    first = (grams[start[:, None] + near] == key[:, None]).argmax(1) + start
    end = start + windows - 1 + runs - 1
    last = end - (grams[end[:, None] - near] == key[:, None]).argmax(1)
    return start, windows, key, np.where(first == last, 1, 2)


SEGMENTS = "uid long, start int, windows int, key long, places int"


def find_segments(width: int, kgram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                data = text.as_buffer()
                found.append(segments_of(word_hashes(np.frombuffer(data, np.uint8)) if data else np.zeros(0, np.uint64), width, kgram))
            uid = np.repeat(batch.column("uid").to_numpy(), [len(x[0]) for x in found])
            start, windows, key, places = (np.concatenate(x) for x in zip(*found)) if found else ([], [], np.zeros(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(key.view(np.int64)), pa.array(places, pa.int32())],
                names=["uid", "start", "windows", "key", "places"],
            )

    return find


CUT = "doc_id {}, uid long, start int, key long, words binary"


def cut_segments(width: int):
    """Words of the listed segments of each text, joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, keys, words = [], [], [], []
            for row, (text, listed) in enumerate(zip(batch.column("text"), batch.column("listed").to_pylist())):
                found = text.as_py().encode().split()
                for part in listed:
                    rows.append(row)
                    starts.append(part["start"])
                    keys.append(part["key"])
                    words.append(b" ".join(found[part["start"] : part["start"] + part["windows"] + width - 1]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("uid").take(at), pa.array(starts, pa.int32()), pa.array(keys, pa.int64()), pa.array(words, pa.binary())],
                names=["doc_id", "uid", "start", "key", "words"],
            )

    return cut


MATCHED = "id1 long, id2 long, covered array<struct<from:int,to:int>>"
_RANGES = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def match_shard(width: int):
    def match(shard: pa.Table) -> pa.Table:
        """Ranges of words of each segment that lie in windows matched twice or more in the shard."""
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        sizes, pieces = [], []
        for words in shard.column("words").to_pylist():
            found = words.split()
            sizes.append(len(found))
            pieces.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        size = np.array(sizes)
        places = shard.column("places").to_numpy()
        zero = np.zeros(1, np.int64)
        text = np.concatenate([x for piece in pieces for x in (zero, piece)] + [zero])  # zeros part the segments
        first = np.cumsum(size + 1) - size  # where each segment starts in the text
        twice = [x for i in np.flatnonzero(places > 1).tolist() for x in (pieces[i], zero)]  # a second copy stands for all others
        index = FMIndex(np.concatenate([text, *twice]), len(numbers) + 1, int(size.max()) if len(size) else 1)
        covered: list[list[dict]] = [[] for _ in sizes]

        def mark(segment: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            for i, a, b in zip(segment.tolist(), (start - first[segment]).tolist(), (end + 1 - first[segment]).tolist()):
                if covered[i] and covered[i][-1]["to"] >= a >= covered[i][-1]["from"]:
                    covered[i][-1]["to"] = max(b, covered[i][-1]["to"])
                else:
                    covered[i].append({"from": a, "to": b})

        # whole segments first: most that come here are matched from end to end
        segment, end = np.arange(len(size)), first + size - 1
        reached = index.reach(text, first, end, 2)
        whole = end - reached + 1 >= width
        mark(segment[whole], reached[whole], end[whole])
        # then window by window from the left, for starts before what the whole segment reached
        segment = np.flatnonzero(reached > first)
        window, limit = first[segment].copy(), np.minimum(reached[segment], end[segment] - width + 1)
        while len(segment):
            going = window < limit
            segment, window, limit = segment[going], window[going], limit[going]
            if not len(segment):
                break
            back = index.reach(text, window, window + width - 1, 2)
            full = back == window
            mark(segment[full], window[full], (window + width - 1)[full])
            window = np.where(full, window + 1, back)  # no window that holds back - 1 and the last word is matched
        some = [i for i, ranges in enumerate(covered) if ranges]
        rows = pa.array(some, pa.int64())
        return pa.table(
            {"id1": shard.column("id1").take(rows), "id2": shard.column("id2").take(rows), "covered": pa.array([covered[i] for i in some], _RANGES)}
        )

    return match


KEPT = "doc_id {}, n_words long, removed array<struct<from:int,to:int>>, kept string"


def drop_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
            sizes, removed, kept = [], [], []
            for text, listed in zip(part.column("text"), part.column("listed").to_pylist()):
                words = text.as_py().encode().split()
                merged: list[dict] = []
                for a, b in sorted((r["from"], r["to"]) for r in listed or []):
                    if merged and a <= merged[-1]["to"]:
                        merged[-1]["to"] = max(merged[-1]["to"], b)
                    else:
                        merged.append({"from": a, "to": b})
                sizes.append(len(words))
                removed.append(merged)
                for r in reversed(merged):
                    del words[r["from"] : r["to"]]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, _RANGES), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "removed", "kept"],
            )


def without_repeats(docs: DataFrame, width: int = WIDTH, kgram: int = KGRAM) -> DataFrame:
    """(doc_id, n_words, removed, kept) for each row of `docs` (doc_id, text): the ranges of words that lie in
    a repeated window, and the words that are left, joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("uid"), text.alias("text"))
    segments = stored(rows.select("uid", "text").mapInArrow(find_segments(width, kgram), SEGMENTS))
    repeated = segments.groupBy("key").agg(F.sum("places").alias("n")).filter("n > 1").select("key")
    wanted = segments.join(repeated, "key").groupBy("uid")
    wanted = stored(wanted.agg(F.collect_set(F.struct("start", "windows", "key")).alias("listed")))
    total = wanted.select(F.sum(F.aggregate("listed", F.lit(0).cast("long"), lambda a, s: a + s["windows"] + width - 1)).alias("n")).first()["n"]
    shards = max(int((total or 0) // SHARD_WORDS) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the same exchange of the texts serves the cutting of segments and the last join
    cut = rows.join(wanted, "uid").select("doc_id", "uid", "text", "listed").mapInArrow(cut_segments(width), CUT.format(kind))
    ids = [F.xxhash64("words").alias("id1"), F.xxhash64("words", F.lit(1)).alias("id2")]
    folded = cut.groupBy("key", "words").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("places"))
    folded = folded.select(F.pmod("key", F.lit(shards)).alias("shard"), *ids, "words", "places")
    matched = folded.groupBy("shard").applyInArrow(match_shard(width), MATCHED)
    matched = matched.dropDuplicates(["id1", "id2"])
    found = cut.select("uid", "start", *ids).join(matched, ["id1", "id2"])
    moved = F.transform("covered", lambda r: F.struct((r["from"] + F.col("start")).alias("from"), (r["to"] + F.col("start")).alias("to")))
    ranges = found.select("uid", F.explode(moved).alias("r")).groupBy("uid").agg(F.collect_set("r").alias("listed"))
    left = rows.join(ranges, "uid", "left").select("doc_id", "uid", "text", "listed")
    return left.mapInArrow(drop_covered, KEPT.format(kind))
