"""Toxicity: a linear classifier learned from confirmed toxic documents and unlabelled ones.

Only documents confirmed as toxic are taken as examples; everything else that the model sees is unlabelled text,
which holds toxic documents too. With a share `prior` of toxic documents in the corpus, the risk over harmless
documents is the risk over unlabelled ones taken as harmless, less the prior times that over toxic ones taken as
harmless. That difference cannot be negative; where a flexible model makes it so, it has learned the unlabelled
sample by heart, and the step goes back (non-negative risk estimation). The logistic loss makes the score an
estimate of the probability that the document is toxic.

The features of a text are the different words it holds, the first letters of these words, which name the stems of
compounds, and its number of words by powers of two. Features are left out that few documents of the sample share,
or that confirmed and unlabelled documents hold about equally often.

Bounds, all of them parameters: the model is fitted on POSITIVE_DOCS confirmed and UNLABELLED_DOCS unlabelled
documents of SAMPLE_CHARS characters at most, those with the smallest hashes of their ids. Every text is scored whole.

Defined results: null and empty texts hold no words, and get the score that the model gives to such a text. Repeated
rows give repeated results, an empty table an empty one. A doc_id that is confirmed as toxic anywhere counts as toxic.
Without confirmed documents, or without unlabelled ones, all texts score the prior. Labels without a document, and
null doc_ids and labels, are not learned from. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.llm.line_crf import held_out
from semaspan.session import stored

POSITIVE_DOCS, UNLABELLED_DOCS = 3_000, 9_000
SAMPLE_CHARS = 20_000
LEAST_DOCS = 4  # documents of the sample that share a feature, at least
LEAST_DEVIATIONS = 5.0  # by which its shares of confirmed and of unlabelled documents differ, at least
STEMS = (5, 7)  # letters of a word that name its stem
SIZES = 40  # features for the number of words
ROUNDS = 250
RATE = 0.05
PENALTY = 1e-4
BELOW, BACK = 0.0, 1.0  # how far the risk over harmless documents may fall, and the size of the step back
LEAST_SCORE = 0.5
FALLBACK_PRIOR = 0.1  # where no label tells the share of toxic documents
MEMO = 400_000  # words whose features a task remembers

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> tuple[set[str], int]:
    """The different words of a text, and how many it has."""
    found = _WORD.findall(text.lower())
    return set(found), len(found)


def names_of(word: str) -> list[str]:
    """The features of a word: itself, and its stems."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]


def size_of(n_words: int) -> int:
    return min(n_words.bit_length(), SIZES - 1)


@dataclass
class Toxicity:
    """Weights of features by name, and of text sizes."""

    weights: dict[str, float]
    sizes: np.ndarray

    def scorer(self):
        """A function from texts to scores, 0 to 1, that remembers the features of words it has met."""
        memo: dict[str, tuple[str, ...]] = {}
        weights, sizes = self.weights, self.sizes

        def score(text: str) -> float:
            words, n = words_of(text)
            held: set[str] = set()
            for word in words:
                names = memo.get(word)
                if names is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    names = memo[word] = tuple(x for x in names_of(word) if x in weights)
                held.update(names)
            logit = float(sizes[size_of(n)]) + sum(sorted(weights[x] for x in held))
            return float(1.0 / (1.0 + np.exp(-np.clip(logit, -500.0, 500.0))))

        return score


def risk(scores: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, float]:
    """The three means of the risk: toxic ones taken as toxic, toxic as harmless, unlabelled as harmless."""
    plus, minus = np.logaddexp(0.0, -scores), np.logaddexp(0.0, scores)
    return prior * float(plus[positive].mean()), prior * float(minus[positive].mean()), float(minus[~positive].mean())


def slope(scores: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk by the scores; a step back where the harmless part falls below zero."""
    share = 1.0 / (1.0 + np.exp(-np.clip(scores, -500.0, 500.0)))  # the slope of the loss of a harmless one
    _, as_harmless, unlabelled = risk(scores, positive, prior)
    many, rest = int(positive.sum()), int((~positive).sum())
    harmless = np.where(positive, -prior * share / many, share / rest)
    if unlabelled - as_harmless < -BELOW:
        return -BACK * harmless
    return np.where(positive, prior * (share - 1.0) / many, 0.0) + harmless


def fitted(documents: list[tuple[list[int], bool]], n_features: int, prior: float) -> np.ndarray:
    """Weights of the features by gradient steps with momentum over the whole sample.

    documents: numbers of the features that each one holds, and whether it is confirmed as toxic.
    """
    rows = np.repeat(np.arange(len(documents)), [len(x) for x, _ in documents])
    cols = np.fromiter((i for x, _ in documents for i in x), np.int64, len(rows))
    positive = np.array([p for _, p in documents])
    weights, first, second = np.zeros(n_features), np.zeros(n_features), np.zeros(n_features)
    for step in range(1, ROUNDS + 1):
        scores = np.bincount(rows, weights[cols], len(documents))
        gradient = np.bincount(cols, slope(scores, positive, prior)[rows], n_features) + PENALTY * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def names_in(words: Column) -> Column:
    """The different features of a text's words."""
    stems = [F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def telling(sample: DataFrame) -> list[str]:
    """The features whose shares of confirmed and of unlabelled documents differ by more than chance.

    sample: (positive, words). No more features can tell than the sample's documents hold.
    """
    totals = sample.agg(F.count_if("positive").alias("many"), F.count_if(~F.col("positive")).alias("rest")).first()
    many, rest = totals["many"], totals["rest"]
    named = sample.select("positive", F.explode(names_in(F.col("words"))).alias("name"))
    shared = named.groupBy("name").agg(F.count_if("positive").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    both, a, b = F.col("n") / (many + rest), F.col("a") / many, (F.col("n") - F.col("a")) / rest
    deviation = F.sqrt(both * (1 - both) * (1 / many + 1 / rest)) + 1e-12
    return sorted(r["name"] for r in shared.filter(F.abs(a - b) >= LEAST_DEVIATIONS * deviation).select("name").collect())


def learned(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Toxicity:
    """A model from (doc_id, text) and (doc_id, toxic), without the documents that are held out.

    prior: the share of toxic documents in the corpus; by default that of the labels.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg("toxic").alias("p")).first()["p"]
        prior = FALLBACK_PRIOR if prior is None else min(0.9, max(1e-4, float(prior)))
    short = F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS
    open_ = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # ids are chosen before any text moves, and the few of them are sent to where the texts are
    ids = open_.filter(short).select("doc_id").distinct()

    def chosen(of: DataFrame, most: int, positive: bool) -> DataFrame:
        return of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(positive).alias("positive"))

    toxic = known.filter("toxic = 1").join(ids, "doc_id", "left_semi")
    sample = chosen(toxic, POSITIVE_DOCS, True).unionByName(chosen(ids, UNLABELLED_DOCS, False))
    texts = open_.filter(short).select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py() or "") for t in batch.column("text")]
            words = pa.array([sorted(w) for w, _ in found], pa.list_(pa.string()))
            sizes = pa.array([size_of(n) for _, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), words, sizes], names=["doc_id", "positive", "words", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shaped = texts.select("doc_id", "positive", "text").mapInArrow(shapes, f"doc_id {kind}, positive boolean, words array<string>, size int")
    once = shaped.groupBy("doc_id", "positive").agg(F.min(F.struct("size", "words")).alias("s"))  # repeated ids count once
    rows = stored(once.select("positive", "s.size", "s.words").distinct())  # and copies too
    sizes = np.full(SIZES, np.log(prior / (1 - prior)))
    if rows.select("positive").distinct().count() < 2:
        return Toxicity({}, sizes)
    names = telling(rows)
    number = {n: SIZES + i for i, n in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted({number[n] for word in words.as_py() for n in names_of(word) if n in number}) for words in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("size"), pa.array(held, pa.list_(pa.int32()))], names=["positive", "size", "held"])

    found = rows.select("positive", "size", "words").mapInArrow(numbered, "positive boolean, size int, held array<int>").collect()
    documents = sorted(([r["size"], *r["held"]], r["positive"]) for r in found)
    weights = fitted(documents, SIZES + len(names), prior)
    met = np.isin(np.arange(SIZES), [d[0][0] for d in documents])
    nearest = np.array([int(np.flatnonzero(met)[np.abs(np.flatnonzero(met) - i).argmin()]) for i in range(SIZES)])
    return Toxicity({n: float(w) for n, w in zip(names, weights[SIZES:])}, weights[nearest])


def toxicity(text: Column | str, model: Toxicity) -> Column:
    """The score of each text, 0 to 1."""
    weights, sizes = model.weights, model.sizes

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Toxicity(weights, sizes).scorer()
        for batch in batches:
            yield pa.array([score(t.as_py() or "") for t in batch], pa.float64())

    return scored(text)
