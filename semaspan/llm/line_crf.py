"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is labelled good or bad from features of its own and of its neighbours; the chain makes labels of
neighbouring lines depend on each other. Forward and backward passes give the marginal of each line, and the
document's score is the mean of "good" over its lines, weighted by their length. The model is fitted on a
bounded sample of labelled documents, each line carrying its document's label, and is sent to the tasks as
two small arrays.

Features come from the text alone. Defined results: null and empty texts have one empty line, and get the
score that the model gives to it. Repeated rows give repeated results, an empty table an empty one.
Documents without a label, and labels without a document, are not learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 4_000  # labelled documents that the model is fitted on, at most
SAMPLE_LINES = 400  # labelled documents with more lines are left out of the sample
ROUNDS = 150
RATE = 0.08
PENALTY = 1e-3
OWN = 14  # features of a line itself
FEATURES = 3 * OWN + 1  # its own, the previous line's, the next line's, and a constant
LEAST_SCORE = 0.3


def own_features(lines: list[str]) -> np.ndarray:
    """(lines, OWN): shape of each line, and how it repeats itself, the one before and the rest of the text."""
    seen: Counter[str] = Counter()
    out = np.zeros((len(lines), OWN), np.float32)
    before = None
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        row = out[i]
        if n:
            chars = sum(map(len, words))
            letters = sum(map(str.isalpha, line))
            upper = sum(map(str.isupper, words))
            distinct = len(set(words))
            pairs = sum(a == b for a, b in zip(words, words[1:]))
            plain = sum(map(str.isalpha, words))
            odd = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')")
            row[:] = (
                min(n, 60) / 60,
                chars / n / 10,
                1 - letters / chars,
                upper / n,
                1 - distinct / n,
                pairs / n,
                plain / n,
                odd / n,
                line.count("|") / n,
                line.count("!") / n,
                float(seen[line] > 0),
                float(line == before),
                float(n < 4),
                sum(map(str.isdigit, line)) / chars,
            )
            seen[line] += 1
        before = line
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and the weight of each line; blank lines are left out, an empty text is one line."""
    lines = [line for line in text.split("\n") if not line.isspace() and line] or [""]
    own = own_features(lines)
    empty = np.zeros((1, OWN), np.float32)
    x = np.hstack([own, np.vstack([empty, own[:-1]]), np.vstack([own[1:], empty]), np.ones((len(lines), 1), np.float32)])
    return x, np.array([len(line) + 1 for line in lines], np.float64)


def marginals(scores: np.ndarray, length: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over documents side by side.

    scores: (docs, lines, 2) log potentials, length: lines of each, chain: (2, 2) log potentials of neighbours.
    Returns the marginals of lines, those of neighbours summed over each document, and the log partition.
    """
    docs, steps, _ = scores.shape
    forward = np.zeros((docs, steps, 2))
    forward[:, 0] = scores[:, 0]
    for t in range(1, steps):
        forward[:, t] = np.logaddexp(forward[:, t - 1, 0, None] + chain[0], forward[:, t - 1, 1, None] + chain[1]) + scores[:, t]
    backward = np.zeros((docs, steps, 2))
    for t in range(steps - 2, -1, -1):
        ahead = scores[:, t + 1] + backward[:, t + 1]
        new = np.logaddexp(ahead[:, 0, None] + chain[:, 0], ahead[:, 1, None] + chain[:, 1])
        backward[:, t] = np.where((t + 1 < length)[:, None], new, 0.0)
    last = forward[np.arange(docs), length - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    alive = np.arange(steps)[None, :] < length[:, None]
    lines = np.exp(forward + backward - total[:, None, None]) * alive[:, :, None]
    if steps > 1:
        joint = forward[:, :-1, :, None] + chain + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]
        pairs = (np.exp(np.minimum(joint, 0.0)) * alive[:, 1:, None, None]).sum(1)
    else:
        pairs = np.zeros((docs, 2, 2))
    return lines, pairs, total


class LineCrf:
    def __init__(self, weights: np.ndarray, chain: np.ndarray):
        self.weights, self.chain = weights, chain

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted share of good lines of each document, 0 to 1."""
        out = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: len(documents[i][1]))
        at = 0
        while at < len(order):  # documents of alike length side by side
            longest = len(documents[order[min(at + 255, len(order) - 1)]][1])
            many = max(1, min(256, 200_000 // longest))
            rows = order[at : at + many]
            at += many
            length = np.array([len(documents[i][1]) for i in rows])
            x = np.zeros((len(rows), int(length.max()), 2))
            for k, i in enumerate(rows):
                x[k, : length[k], 1] = documents[i][0] @ self.weights
            lines, _, _ = marginals(x, length, self.chain)
            for k, i in enumerate(rows):
                weight = documents[i][1]
                out[i] = float((lines[k, : length[k], 1] * weight).sum() / weight.sum())
        return np.clip(out, 0.0, 1.0)


def fitted(documents: list[tuple[np.ndarray, int]]) -> LineCrf:
    """Maximum likelihood by gradient steps with momentum; labels count alike, however many carry them."""
    weights, chain = np.zeros(FEATURES), np.zeros((2, 2))
    labels = Counter(label for _, label in documents)
    if not documents:
        return LineCrf(weights, chain)
    documents = sorted(documents, key=lambda d: len(d[0]))
    groups = []
    for at in range(0, len(documents), 256):
        part = documents[at : at + 256]
        length = np.array([len(x) for x, _ in part])
        x = np.zeros((len(part), int(length.max()), FEATURES))
        for k, (own, _) in enumerate(part):
            x[k, : len(own)] = own
        y = np.array([label for _, label in part])
        # a document counts once, whatever its lines
        share = np.array([len(documents) / (2 * labels[label]) for _, label in part]) / length
        groups.append((x, length, y, share))
    total = sum(len(y) for _, _, y, _ in groups)
    first = [np.zeros(FEATURES), np.zeros((2, 2))]
    second = [np.zeros(FEATURES), np.zeros((2, 2))]
    for step in range(1, ROUNDS + 1):
        gradients = [-PENALTY * weights, -PENALTY * chain]
        for x, length, y, share in groups:
            scores = np.zeros((*x.shape[:2], 2))
            scores[:, :, 1] = x @ weights
            lines, pairs, _ = marginals(scores, length, chain)
            alive = np.arange(x.shape[1])[None, :] < length[:, None]
            wrong = ((y[:, None] - lines[:, :, 1]) * alive) * share[:, None]
            gradients[0] = gradients[0] + np.einsum("dt,dtf->f", wrong, x) / total
            seen = np.zeros((len(y), 2, 2))
            seen[np.arange(len(y)), y, y] = length - 1
            gradients[1] = gradients[1] + ((seen - pairs) * share[:, None, None]).sum(0) / total
        for k, value in enumerate((weights, chain)):
            first[k] = 0.9 * first[k] + 0.1 * gradients[k]
            second[k] = 0.999 * second[k] + 0.001 * gradients[k] ** 2
            value += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return LineCrf(weights, chain)


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> LineCrf:
    """A model from (doc_id, text) and (doc_id, quality): the labelled rows with the smallest hashes of their ids.

    At most SAMPLE_DOCS documents of at most SAMPLE_LINES lines come to the driver, as features.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # ids are chosen before any text moves, and the few of them are sent to where the texts are
    short = docs.select("doc_id", (lines <= SAMPLE_LINES).alias("short")).filter("short").select("doc_id").distinct()
    chosen = known.join(short, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.select("doc_id", "text").filter(lines <= SAMPLE_LINES).join(F.broadcast(chosen), "doc_id")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "")[0].tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sample.select("doc_id", "quality", "text").mapInArrow(shapes, f"doc_id {kind}, quality int, x binary")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))  # repeated ids count once
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    return fitted([(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES), r["quality"]) for r in rows])


def quality(text: Column | str, model: LineCrf) -> Column:
    """The score of each text, 0 to 1."""
    weights, chain = model.weights, model.chain

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = LineCrf(weights, chain)
        for batch in batches:
            for at in range(0, len(batch), 500):
                yield pa.array(crf.scores([features(t.as_py() or "") for t in batch.slice(at, 500)]), pa.float64())

    return scored(text)
