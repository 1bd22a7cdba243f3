"""Mixing sources to target weights by iterative proportional fitting, and sampling by calibrated probabilities.

Tokens are counted by cell (source, language, topic). Cell weights are raked in turn to the target shares of
sources, languages and topics until all three agree. The weights become sampling rates, scaled so that the
expected tokens meet the budget with no rate above 1, and each document is drawn by a hash of its id.

Cells are sums over the corpus, folded before they move. Raking goes over the cells, not over documents:
cells up to DRIVER_CELLS are raked with arrays, more of them as a table, with the same result.

Defined results: null sources, languages and topics are values of their own; null texts count as empty.
Targets name values; values without a target share what the named ones leave, in proportion to their tokens.
Repeated rows are drawn alike, as they have the same id. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.session import stored

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.5  # default targets: shares of tokens to this power, so that large values shrink
ROUNDS = 60
CLOSE = 1e-9
DRIVER_CELLS = 200_000  # cells raked on the driver; beyond, the same steps run as joins
BUDGET = 0.5  # share of all tokens that the sample is expected to hold
SEED = 17

# Topics by what a text is full of: the first pattern that is frequent enough names it.
TOPICS = {
    "lists": (r"[^|•*]+", 0.01),
    "figures": (r"[^0-9]+", 0.02),
    "dialogue": (r"[^!?\"“”]+", 0.006),
}


def topic_of(text: Column) -> Column:
    """lists, figures, dialogue, brief or prose, by the shares of telling characters and by length."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    chain = F.when(F.length(text) < 600, "brief")
    for name, (others, least) in TOPICS.items():
        chain = chain.when(F.length(F.regexp_replace(text, others, "")) / size >= least, name)
    return chain.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words of a text, as its size."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(tokens: Mapping, targets: Mapping | None, temper: float) -> dict:
    """Target share of each value; the rest of what is named goes to the others by tempered tokens."""
    named = {v: float(s) for v, s in (targets or {}).items() if v in tokens and tokens[v] > 0}
    others = {v: float(n) ** temper for v, n in tokens.items() if v not in named and n > 0}
    left = max(0.0, 1.0 - sum(named.values())) if others else 0.0
    out = {**named, **{v: left * x / sum(others.values()) for v, x in others.items()}}
    total = sum(out.values())
    return {v: x / total for v, x in out.items()} if total else out


def margins(cells: DataFrame, targets: Mapping[str, Mapping], temper: float) -> dict[str, dict]:
    """Target shares by dimension; one row a value comes to the driver."""
    found = {}
    for d in DIMENSIONS:
        rows = cells.groupBy(d).agg(F.sum("tokens").alias("n")).collect()
        found[d] = shares({r[d]: r["n"] for r in rows}, targets.get(d), temper)
    return found


def raked_rows(cells: pd.DataFrame, goals: Mapping[str, Mapping]) -> np.ndarray:
    """Weights of cells whose sums by dimension meet the goals, as near as the cells allow."""
    weight = cells["tokens"].to_numpy(float) / max(cells["tokens"].sum(), 1)
    codes = {}
    for d in DIMENSIONS:
        values = list(goals[d])
        place = {v: i for i, v in enumerate(values)}
        codes[d] = (np.array([place.get(v, 0) for v in cells[d]], int), np.array([goals[d][v] for v in values]))
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in codes.values():
            sums = np.bincount(code, weight, len(goal))
            worst = max(worst, np.abs(sums - goal).max(initial=0.0))
            weight = weight * np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[code]
        if worst < CLOSE:
            break
    return weight


def raked_table(cells: DataFrame, goals: Mapping[str, Mapping]) -> DataFrame:
    """The same over a table of cells: each step is a sum by one dimension, joined back."""
    session = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = stored(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))))
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            kind = cells.schema[d].dataType.simpleString()
            goal = session.createDataFrame(list(goals[d].items()), f"_value {kind}, _goal double")
            sums = cells.groupBy(F.col(d).alias("_value")).agg(F.sum("weight").alias("_sum"))
            factor = sums.join(goal, sums["_value"].eqNullSafe(goal["_value"])).select(
                sums["_value"], "_sum", "_goal", F.when(F.col("_sum") > 0, F.col("_goal") / F.col("_sum")).otherwise(0.0).alias("_factor")
            )
            factor = stored(factor)
            worst = max(worst, factor.agg(F.max(F.abs(F.col("_sum") - F.col("_goal")))).first()[0] or 0.0)
            joined = cells.join(factor.select("_value", "_factor"), F.col(d).eqNullSafe(F.col("_value")))
            cells = stored(joined.select(*DIMENSIONS, "tokens", (F.col("weight") * F.col("_factor")).alias("weight")))
        if worst < CLOSE:
            break
    return cells


def scale(cells: DataFrame, budget: float) -> float:
    """The factor c for which the tokens drawn at rates least(1, c * weight / tokens) come to the budget.

    Found by bisection over the cells' sums; each step is one sum of the table of cells.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goal, low, high = budget * total, 0.0, float(total)
    for _ in range(40):
        steps = [low + (high - low) * i / 16 for i in range(1, 17)]
        drawn = cells.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.lit(c) * F.col("weight"))).alias(f"c{i}") for i, c in enumerate(steps)]).first()
        got = [x or 0.0 for x in drawn]
        above = next((i for i, x in enumerate(got) if x >= goal), None)
        if above is None:
            if high > 1e6 * max(total, 1):
                return high  # all that has a weight is drawn whole
            low, high = high, high * 16
            continue
        low, high = (steps[above - 1] if above else low), steps[above]
        if high - low <= 1e-9 * high:
            break
    return high


def rates(cells: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """(source, lang, topic, tokens, weight, rate) from (source, lang, topic, tokens)."""
    cells = stored(cells)
    session = cells.sparkSession
    goals = margins(cells, targets or {}, temper)
    if cells.count() <= DRIVER_CELLS:
        rows = cells.collect()
        frame = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object if c in DIMENSIONS else float) for c in (*DIMENSIONS, "tokens")})
        frame = frame.astype({d: object for d in DIMENSIONS})
        weight = raked_rows(frame, goals) if rows else np.zeros(0)
        schema = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMENSIONS) + ", tokens long, weight double"
        raked = session.createDataFrame([(*[r[d] for d in DIMENSIONS], r["tokens"], float(w)) for r, w in zip(rows, weight)], schema)
    else:
        raked = raked_table(cells, goals)
    factor = scale(raked, budget)
    rate = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens"))).otherwise(0.0)
    return raked.withColumn("rate", rate)


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def with_rates(docs: DataFrame, found: DataFrame, topic: Column) -> DataFrame:
    """`docs` with the topic, the rate of its cell, and whether it is drawn; texts don't move."""
    known = found.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("rate").alias("_rate"))
    if known.count() <= DRIVER_CELLS:  # counted, so small enough to send to all tasks; else Spark joins by shuffling
        known = F.broadcast(known)
    docs = docs.withColumn("topic", topic)
    match = reduce(Column.__and__, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS])
    joined = docs.join(known, match, "left").withColumn("rate", F.coalesce("_rate", F.lit(0.0)))
    return joined.withColumn("drawn", draw(F.col("doc_id")) < F.col("rate")).drop("_rate", *[f"_{d}" for d in DIMENSIONS])


def cell_rates(rows: DataFrame, targets: Mapping[str, Mapping] | None, budget: float, temper: float) -> DataFrame:
    """Rates of the cells of rows (source, lang, topic, tokens)."""
    return rates(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), targets, budget, temper)


def mixed(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, temper: float = TEMPER, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, rate, drawn) for each row of `docs` (doc_id, text, source, lang).

    targets: dimension -> value -> share; a dimension without targets takes tempered shares. topic: how a
    text gets its topic, `topic_of` unless given.
    """
    topic = topic_of(F.col("text")) if topic is None else topic
    rows = stored(docs.select("doc_id", "source", "lang", topic.alias("topic"), tokens_of(F.col("text")).alias("tokens")))
    return with_rates(rows, cell_rates(rows, targets, budget, temper), F.col("topic"))


def sampled(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """Rows of `docs` that are drawn, with all their columns."""
    topic = topic_of(F.col("text"))
    found = cell_rates(docs.select("source", "lang", topic.alias("topic"), tokens_of(F.col("text")).alias("tokens")), targets, budget, temper)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "lang", "text")
    return with_rates(whole, found, topic).filter("drawn").select("row.*")
