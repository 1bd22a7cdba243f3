"""Hard-negative mining with bounds carried along a spanning tree of the anchors.

Vectors are scaled to whole numbers, so scores (inner products) are exact. For each anchor its best rows of the
same label are the positives; for each anchor and positive the best rows of other labels whose score lies in a
window below the positive's are the hard negatives.

Anchors are parted into blocks of near ones, and each block gets a minimum spanning tree. Rows are dealt to chunks,
and every chunk meets every block: a stated set of anchors against all rows, in blocks of bounded size. Inside, the
tree is walked from its root. A row whose score with the parent lies in [low, high] has a score with the child in
[low - edge * norm, high + edge * norm], as inner products differ by at most the distance of the anchors times the
row's norm. Only rows whose interval meets what the anchor still looks for are scored exactly: its window, raised to
the k-th largest lower bound among the rows that surely lie in it. So no row of the answer is lost.

Defined results: rows take part once for each vec_id (that with the smallest label and vector, if it is repeated),
and not at all if vec_id, label or vector is null or a component is null or not finite. Vectors of different lengths
are compared as if the shorter one ended in zeros; empty vectors score 0 with everything. Ties go to the smaller
vec_id. Components beyond 64 bits count as the nearest 64-bit number, and so do scores; scores that doubles cannot
hold are computed with Python's integers, without bounds. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.session import stored

SCALE = 256  # a component becomes the whole part of so many times its value
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score lies between these per cents of the positive's
BLOCK = 8_192  # anchors of a block, about
CHUNK = 32_768  # rows of a chunk, about
SMALL_CHUNK = 1_024  # rows of a chunk at least, where a smaller table is dealt to all tasks
PIVOTS = 256  # anchors that blocks are gathered around, at most
EXACT = 2.0**53  # doubles hold whole numbers below this


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows that take part, once each, with whole components."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    edge = 9.2e18  # doubles that 64 bits surely hold
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), x * F.lit(float(SCALE))))))
    once = rows.select("vec_id", F.struct("label", whole.alias("v")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return once.select("vec_id", "r.label", "r.v")


def matrix(lists: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, filled with zeros to the longest of them or to `width`."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for row 0, the root) and distance to it for each row, of a minimum spanning tree by Prim's rule."""
    n = len(points)
    x = points.astype(np.float64)
    squares = (x * x).sum(1)
    parent, edge = np.full(n, -1), np.zeros(n)
    nearest, of = np.full(n, np.inf), np.zeros(n, np.int64)
    outside = np.ones(n, bool)
    last = 0
    for _ in range(n - 1):
        outside[last] = False
        far = np.maximum(squares + squares[last] - 2.0 * (x @ x[last]), 0.0)
        closer = outside & (far < nearest)
        nearest[closer], of[closer] = far[closer], last
        last = int(np.where(outside, nearest, np.inf).argmin())
        parent[last] = of[last]
        edge[last] = math.sqrt(float(((x[last] - x[of[last]]) ** 2).sum()))  # anew, free of cancellation
    return parent, edge


def walk(parent: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, its parent) with parents first and the largest subtree last, so that few parents are open at a time."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        if parent[i] >= 0:
            children[parent[i]].append(i)
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack += children[i]
    size = np.ones(n, np.int64)
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    stack = [0] if n else []
    while stack:
        i = stack.pop()
        yield i, int(parent[i])
        stack += sorted(children[i], key=lambda c: -size[c])  # the last pushed, which is walked first, is the smallest


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


@dataclass
class Chunk:
    """Candidate rows, sorted by vec_id, so that an order by score that keeps places breaks ties by vec_id."""

    ids: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, width: int = 0) -> Chunk:
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = matrix(rows.column("v"), width)[order]
        return cls(ids[order], rows.column("label").to_numpy()[order], v, np.sqrt((v.astype(np.float64) ** 2).sum(1)))


class Scores:
    """Exact scores of a chunk's rows with the anchors of a block, each row scored only where its bounds ask for it."""

    def __init__(self, chunk: Chunk, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.chunk, self.parent, self.edge = chunk, parent, edge
        most = float(np.abs(chunk.v.astype(np.float64)).max(initial=0)) * float(np.abs(anchors.astype(np.float64)).max(initial=0))
        self.exact = 100.0 * max(1, anchors.shape[1]) * most < EXACT
        kind = np.float64 if self.exact else object
        self.v, self.anchors = chunk.v.astype(kind), anchors.astype(kind)
        self.norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
        self.scored = 0  # rows that were scored exactly, over all anchors

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, low, high) for each anchor; the caller may call `score` before it goes on."""
        open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left = np.bincount(self.parent[self.parent >= 0], minlength=len(self.parent))
        for i, up in walk(self.parent):
            reach = self.norms[i] * self.chunk.norm
            slack = 1e-6 + 1e-9 * reach
            if not self.exact:
                low, high = np.full(len(reach), -np.inf), np.full(len(reach), np.inf)
            elif up < 0:
                low, high = -reach - slack, reach + slack
            else:
                step = self.edge[i] * (1 + 1e-9) * self.chunk.norm + slack
                low = np.maximum(open_[up][0] - step, -reach - slack)
                high = np.minimum(open_[up][1] + step, reach + slack)
            yield i, low, high
            if left[i]:
                open_[i] = (low, high)
            if up >= 0:
                left[up] -= 1
                if not left[up]:
                    del open_[up]

    def score(self, anchor: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the wanted rows, whose bounds close on them."""
        rows = np.flatnonzero(wanted)
        self.scored += len(rows)
        part = self.v if len(rows) == len(wanted) else self.v[rows]
        found = part @ self.anchors[anchor]
        if self.exact:
            low[rows] = found
            high[rows] = found
        return rows, found


def _best(rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by place."""
    if len(rows) > 4 * k and score.dtype != object:
        keep = score >= _kth(score, k)
        rows, score = rows[keep], score[keep]
    order = np.argsort(-score, kind="stable")[:k]
    return rows[order], score[order]


def _whole(scores: list[np.ndarray]) -> pa.Array:
    flat = [int(x) for part in scores for x in part]
    return pa.array([max(-(2**63), min(2**63 - 1, x)) for x in flat], pa.int64())


def best_positives(scores: Scores, ids: np.ndarray, labels: np.ndarray, k: int = POSITIVES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): the chunk's k best other rows of each anchor's label."""
    chunk = scores.chunk
    for i, low, high in scores.walk():
        same = (chunk.label == labels[i]) & (chunk.ids != ids[i])
        wanted = same & (high >= _kth(low[same], k))
        rows, found = scores.score(i, wanted, low, high)
        yield i, *_best(rows, found, k)


def best_negatives(
    scores: Scores, labels: np.ndarray, positives: list[list[int]], k: int = NEGATIVES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, number of its positive, rows, scores): the chunk's k best rows of other labels inside each window."""
    chunk = scores.chunk
    for i, low, high in scores.walk():
        other = chunk.label != labels[i]
        wanted = np.zeros(len(other), bool)
        if scores.exact:
            for p in positives[i]:
                sure = low[other & (100.0 * low >= LOW * p) & (100.0 * high <= HIGH * p)]
                wanted |= other & (high >= _kth(sure, k)) & (100.0 * high >= LOW * p) & (100.0 * low <= HIGH * p)
        else:
            wanted = other
        rows, found = scores.score(i, wanted, low, high)
        for at, p in enumerate(positives[i]):
            inside = (100 * found >= LOW * p) & (100 * found <= HIGH * p)
            inside = inside.astype(bool)
            yield i, at, *_best(rows[inside], found[inside], k)


def _scores(rows: pa.Table, anchors: pa.Table) -> tuple[Scores, pa.Table]:
    anchors = anchors.sort_by("place")
    a = matrix(anchors.column("v"))
    chunk = Chunk.of(rows, a.shape[1])
    a = matrix(anchors.column("v"), chunk.v.shape[1])
    return Scores(chunk, a, anchors.column("parent").to_numpy(), anchors.column("edge").to_numpy()), anchors


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    if not len(rows) or not len(anchors):
        return pa.table({"anchor_id": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "positive_score": pa.array([], pa.int64())})
    scores, anchors = _scores(rows, anchors)
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    a, p, s = [], [], []
    for i, at, found in best_positives(scores, ids, labels):
        a.append(np.full(len(at), ids[i]))
        p.append(scores.chunk.ids[at])
        s.append(found)
    return pa.table({"anchor_id": pa.array(np.concatenate(a)), "positive_id": pa.array(np.concatenate(p)), "positive_score": _whole(s)})


MINED = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    if not len(rows) or not len(anchors):
        return pa.table({c: pa.array([], pa.int64()) for c in MINED})
    scores, anchors = _scores(rows, anchors)
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    listed = anchors.column("positives").to_pylist()
    a, p, q, n, s = [], [], [], [], []
    for i, k, at, found in best_negatives(scores, labels, [[x["positive_score"] for x in row] for row in listed]):
        positive = listed[i][k]
        a.append(np.full(len(at), ids[i]))
        p.append(np.full(len(at), positive["positive_id"]))
        q.append(np.full(len(at), positive["positive_score"]))
        n.append(scores.chunk.ids[at])
        s.append(found)
    if not a:
        return pa.table({c: pa.array([], pa.int64()) for c in MINED})
    columns = [pa.array(np.concatenate(x)) for x in (a, p, q, n)]
    return pa.Table.from_arrays([*columns, _whole(s)], names=MINED)


def _planted(block: pa.Table) -> pa.Table:
    """A block's anchors with their places in its tree."""
    block = block.sort_by("vec_id")
    parent, edge = spanning_tree(matrix(block.column("v")))
    places = pa.array(np.arange(len(block)))
    return block.select(["block", "vec_id", "label", "v"]).append_column("place", places).append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))


PLANTED = "block int, vec_id long, label long, v array<long>, place long, parent long, edge double"


def blocks_of(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors with the number of their block: the nearest of some sampled anchors, parted where it has many."""
    many = min(PIVOTS, math.ceil(n / BLOCK))
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).collect() if many > 1 else []
    width = max((len(r["v"]) for r in sample), default=0)
    pivots = np.zeros((max(1, len(sample)), width))
    for row, r in zip(pivots, sample):
        row[: len(r["v"])] = r["v"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width).astype(np.float64)
            p = np.pad(pivots, ((0, 0), (0, v.shape[1] - width)))
            far = (p * p).sum(1)[None, :] - 2.0 * (v @ p.T)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(1).astype(np.int32))], names=["vec_id", "label", "v", "pivot"])

    placed = stored(anchors.select("vec_id", "label", "v").mapInArrow(nearest, "vec_id long, label long, v array<long>, pivot int"))
    sizes = placed.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "pivot")  # one row a pivot
    block = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int") * F.lit(PIVOTS) + F.col("pivot")
    return dealt.select(block.alias("block"), "vec_id", "label", "v")


def _met(rows: DataFrame, anchors: DataFrame, chunks: int, found, schema: str) -> DataFrame:
    """Each chunk of rows beside each block of anchors."""
    numbers = [r["block"] for r in anchors.select("block").distinct().orderBy("block").collect()]  # one number a block
    if not numbers:
        return rows.sparkSession.createDataFrame([], schema)
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    spread = rows.select(chunk.alias("chunk"), F.explode(F.array(*[F.lit(b) for b in numbers])).alias("block"), "vec_id", "label", "v")
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), *anchors.columns)
    return spread.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(found, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    rows: (vec_id, label, v) as `usable` gives them. is_anchor: which rows are anchors; all rows are candidates.
    """
    rows = stored(rows)
    n = rows.count()
    anchors = rows.filter(is_anchor)
    planted = stored(blocks_of(anchors, anchors.count()).groupBy("block").applyInArrow(_planted, PLANTED))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, math.ceil(n / CHUNK), min(tasks, math.ceil(n / SMALL_CHUNK)))

    near = _met(rows, planted, chunks, _positives, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= POSITIVES)
    # a window below a negative score is empty
    near = near.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"))
    listed = near.agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    none = F.array().cast("array<struct<positive_id:bigint,positive_score:bigint>>")
    # anchors without a positive stay, as they may be parents in the tree
    asked = stored(planted.join(listed, "vec_id", "left").select(*planted.columns, F.coalesce("positives", none).alias("positives")))

    mined = _met(rows, asked, chunks, _negatives, ", ".join(f"{c} long" for c in MINED))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
