"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample of the vectors, with a price on full lists so that lists get alike
in size. Every vector goes to its nearest list and is replicated to others nearly as near, so that vectors
at a boundary are found from either side. A query walks a graph over the centroids, held in memory, and
takes the lists whose distance is within a ratio of the nearest one's. Nothing else selects lists; the ratio is
fitted on the sample, as the smallest by which queries of the sample find RECALL of their neighbours there.
Neighbours in the whole table are nearer than those in the sample, so they are found more easily.
Lists and the queries that search them are parted into shares of a bounded number of vectors, so a list of many
equal vectors is scanned by many tasks, and distances are exact.

The centroids are the only thing broadcast: at most MOST_LISTS of them, whatever the input.

Defined results: vectors that are null, all zero, of another length than most of the sample, or that hold
null or non-finite components take no part. Repeated rows of a vec_id count once. A query never finds its own
vec_id. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.session import settle

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most
MOST_LISTS = 4_096
LIST_SIZE = 400  # vectors of the sample or table that make one list, as long as MOST_LISTS allow
REPLICAS = 3  # lists that a vector goes to, at most
REPLICA_RATIO = 1.12  # and these are no further than so many times its nearest one
RECALL = 0.97  # share of the sample's neighbours that the fitted ratio finds
SAMPLE_QUERIES, SAMPLE_NEAREST = 512, 10  # queries of the sample that the ratio is fitted on, and their neighbours
SHARE = 20_000  # vectors of a list that one task scans, about, and queries that it scans them for
NEIGHBOURS, BEAM = 16, 128  # edges of the centroid graph, and how many centroids a walk keeps at least
SEED = 11


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with the vectors that take part, once each, in double precision."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def balanced_centroids(sample: np.ndarray, n_lists: int, rounds: int = 12) -> np.ndarray:
    """k-means whose distances carry a price for lists that are fuller than the mean."""
    random = np.random.default_rng(SEED)
    centroids = sample[np.sort(random.choice(len(sample), n_lists, replace=False))].copy()
    price = np.zeros(n_lists)
    for _ in range(rounds):
        nearest = np.concatenate([(squared(part, centroids) + price).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 2000))])
        sizes = np.bincount(nearest, minlength=n_lists)
        spread = np.mean(squared(sample[:200], centroids).min(1)) + 1e-12
        price += 0.1 * spread * (sizes / sizes.mean() - 1.0)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        filled = sizes > 0
        centroids[filled] = sums[filled] / sizes[filled, None]
    return centroids


class CentroidGraph:
    """Neighbour graph over the centroids, walked from a few entries with a beam."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        k = min(NEIGHBOURS, n - 1)
        edges = [set() for _ in range(n)]
        for at in range(0, n, 512):
            part = squared(centroids[at : at + 512], centroids)
            for i, row in enumerate(np.argsort(part, axis=1, kind="stable")[:, 1 : k + 1], at):
                for j in row.tolist():
                    edges[i].add(j)
                    edges[j].add(i)
        for i in range(n):  # a ring through all nodes keeps the graph in one piece
            edges[i].add((i + 1) % n)
            edges[(i + 1) % n].add(i)
        self.edges = [np.array(sorted(e - {i}), dtype=np.int64) for i, e in enumerate(edges)]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def nearest(self, query: np.ndarray, least: int = 0, ratio: float = 0.0, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Centroids met on the walk, nearest first, with their distances.

        Wanted are `least` of them, and all within `ratio` times the nearest one's distance (`floor` if that is more).
        """
        beam = max(BEAM, least)

        def far(nodes: np.ndarray) -> np.ndarray:
            return np.sqrt(((self.centroids[nodes] - query) ** 2).sum(1))

        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        met = list(zip(far(self.entries).tolist(), self.entries.tolist()))
        open_ = list(met)
        heapq.heapify(open_)
        best = [-d for d, _ in heapq.nsmallest(beam, met)]
        heapq.heapify(best)
        first = min(met)[0]
        while open_:
            d, node = heapq.heappop(open_)
            if len(best) >= beam and d > max(-best[0], ratio * max(first, floor)):
                break
            new = self.edges[node][~seen[self.edges[node]]]
            seen[new] = True
            for e, other in zip(far(new).tolist(), new.tolist()):
                first = min(first, e)
                if len(best) < beam or e < -best[0]:
                    heapq.heappush(open_, (e, other))
                    heapq.heappush(best, -e)
                    if len(best) > beam:
                        heapq.heappop(best)
                elif e <= ratio * max(first, floor):
                    heapq.heappush(open_, (e, other))
                met.append((e, other))
        met.sort()
        return np.array([i for _, i in met], dtype=np.int64), np.array([d for d, _ in met])


def lists_of_vectors(v: np.ndarray, centroids: np.ndarray) -> list[list[int]]:
    """Lists of each vector: the nearest, and others by the ratio of distances."""
    k = min(REPLICAS, len(centroids))
    out = []
    for at in range(0, len(v), 1024):
        d = np.sqrt(squared(v[at : at + 1024], centroids))
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        out += [row[ok].tolist() for row, ok in zip(near, dist <= REPLICA_RATIO * dist[:, :1] + 1e-12)]
    return out


def lists_of_queries(v: np.ndarray, graph: CentroidGraph, ratio: float, floor: float) -> list[list[int]]:
    """Lists of each query by the ratio of distances alone, nearest first."""
    out = []
    for query in v:
        nodes, dist = graph.nearest(query, ratio=ratio, floor=floor)
        out.append(nodes[dist <= ratio * max(dist[0], floor) + 1e-12].tolist())
    return out


def fitted_ratio(sample: np.ndarray, centroids: np.ndarray) -> tuple[float, float]:
    """(ratio, floor): lists within `ratio` times the nearest one's distance hold RECALL of the sample's neighbours.

    The floor, a low distance of the sample's queries, stands for the nearest distance of a query that lies on a
    centroid, where a ratio means nothing.
    """
    chosen = np.sort(np.random.default_rng(SEED).choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False))
    k = min(SAMPLE_NEAREST, len(sample) - 1)
    if not k:
        return 1.0, 0.0
    neighbours = np.zeros((len(chosen), k), np.int64)
    for at in range(0, len(chosen), 64):
        part = chosen[at : at + 64]
        d = squared(sample[part], sample)
        d[np.arange(len(part)), part] = np.inf
        neighbours[at : at + 64] = np.argpartition(d, k - 1, axis=1)[:, :k]
    held = np.unique(neighbours)
    lists = dict(zip(held.tolist(), lists_of_vectors(sample[held], centroids)))
    far = np.sqrt(squared(sample[chosen], centroids))
    floor = float(np.quantile(far.min(1), 0.1))
    first = np.maximum(far.min(1), floor) + 1e-300
    needed = [row[lists[i]].min() / d for row, d, near in zip(far, first, neighbours.tolist()) for i in near]
    return max(1.0, float(np.quantile(needed, RECALL, method="higher"))), floor


def sampled(vectors: DataFrame) -> np.ndarray:
    """Different vectors of the length that most have, from the rows with the smallest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    lengths = np.bincount([len(r["v"]) for r in rows])
    length = int(lengths.argmax())
    return np.unique(np.array([r["v"] for r in rows if len(r["v"]) == length]), axis=0)


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids of the lists for `n` vectors."""
    return balanced_centroids(sample, max(1, min(MOST_LISTS, n // LIST_SIZE, len(sample) // 4)))


def placed(rows: DataFrame, centroids: np.ndarray, searched: tuple[float, float] | None = None) -> DataFrame:
    """(list, vec_id, v) for each list that a row goes to, or that it searches by a ratio and floor."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(shared.value) if searched else None
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("v").flatten().to_numpy().reshape(len(batch), -1)
            lists = lists_of_queries(v, graph, *searched) if searched else lists_of_vectors(v, shared.value)
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            table = batch.take(pa.array(at))
            numbers = pa.array([i for x in lists for i in x], pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, table.column("vec_id"), table.column("v")], names=["list", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(assign, "list int, vec_id long, v array<double>")


SCANNED = "query_id long, vec_id long, score double"


def nearest_in_share(k: int):
    """For a share of one list and the queries that search it: each query's k nearest of the share."""

    def scan(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros((0, 3))]
        if len(vectors) and len(queries):
            ids = vectors.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            v = vectors.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
            q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(len(queries), -1)
            out_q, out_v, out_s = [], [], []
            for query, values in zip(queries.column("vec_id").to_pylist(), q):
                score = np.sqrt(((v - values) ** 2).sum(1))
                score[ids == query] = np.inf
                best = np.argsort(score, kind="stable")[:k] if len(score) <= 4 * k else _smallest(score, k)
                best = best[np.isfinite(score[best])]
                out_q.append(np.full(len(best), query))
                out_v.append(ids[best])
                out_s.append(score[best])
            arrays = [pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)]
        else:
            arrays = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return scan


def _smallest(score: np.ndarray, k: int) -> np.ndarray:
    """The k smallest, ties by position, without sorting all."""
    bound = np.partition(score, k - 1)[k - 1]
    near = np.flatnonzero(score <= bound)
    return near[np.argsort(score[near], kind="stable")][:k]


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance.

    vectors: (vec_id, v) as `usable` gives them. is_query: which rows are queries; all rows are candidates.
    """
    session = vectors.sparkSession
    vectors = vectors.groupBy("vec_id").agg(F.min("v").alias("v"))  # repeated ids count once
    sample = sampled(vectors)
    if not len(sample):
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centroids = fitted(sample, vectors.count())
    vectors = vectors.filter(F.size("v") == sample.shape[1])
    entries = placed(vectors, centroids)
    asked = settle(placed(vectors.filter(is_query), centroids, fitted_ratio(sample, centroids)))  # counted, then sent

    def shares(rows: DataFrame, name: str) -> DataFrame:
        # there are at most MOST_LISTS lists
        return F.broadcast(rows.groupBy("list").count().select("list", F.ceil(F.col("count") / SHARE).cast("int").alias(name)))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one share of its own side, beside every share of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        own_share = F.pmod(F.xxhash64("vec_id"), F.col(f"{own}s")).cast("int").alias(own)
        both = rows.join(held, "list").join(wanted, "list").select("list", own_share, every, "vec_id", "v")
        # fresh names, as both sides come from the same rows and sizes
        return both.select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "v")])

    keys = ["list", "share", "part"]
    held, wanted = shares(entries, "shares"), shares(asked, "parts")
    entries, asked = dealt(entries, "share", "part"), dealt(asked, "part", "share")
    scanned = entries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest_in_share(k), SCANNED)
    once = scanned.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
