"""Ranks and running aggregates in global order, and exact quantiles by counting, that never put a whole group into one task.

`ordered` sorts all rows with Spark's range partitioning and settles them, so each partition is one
slice of the global order. Running values are computed inside the slices and shifted by what the
earlier slices hold; the table of shifts has at most one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.plans.joins import BROADCAST_ROWS, lookup_join
from semaspan.session import settle, stored

# Up to this many rows a top-k is taken with a heap per task; beyond it with a distributed sort.
HEAP_ROWS = 10_000

_SLICE_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """`df` in global order, settled, with its slice number and the position inside the slice."""
    placed = settle(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()))
    return placed.withColumns(
        {
            "_slice": F.shiftright("_seq", _SLICE_BITS),
            "_nth": F.col("_seq").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1)),
        }
    ).drop("_seq")


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in the given order."""
    rows = ordered(df, order)
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        rows.groupBy("_slice")
        .agg(F.count("*").alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    return rows.join(F.broadcast(shifts), "_slice").select(
        *df.columns, (F.col("_shift") + F.col("_nth") + F.lit(start)).cast("long").alias(name)
    )


def top_ranked(df: DataFrame, order: Sequence[Column | str], n: int, name: str = "rank", start: int = 1) -> DataFrame:
    """The first `n` rows in the given order, numbered."""
    if n > HEAP_ROWS:
        return global_rank(df, order, name, start).filter(F.col(name) < start + n)
    best = df.orderBy(*order).limit(n)
    return best.withColumn(name, (F.row_number().over(W.orderBy(*order)) + F.lit(start - 1)).cast("long"))


def running(rows: DataFrame, groups: Sequence[str], aggregates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add inclusive running aggregates to the rows of `ordered`, restarting with each group.

    aggregates: new column -> (kind, column), kind "sum" or "min". The order given to `ordered`
    must start with `groups`.
    """
    kinds = {"sum": F.sum, "min": F.min}
    inside = W.partitionBy("_slice", *groups).orderBy("_nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)

    per_slice = rows.groupBy("_slice", *groups).agg(
        *[kinds[kind](column).alias(f"_part_{name}") for name, (kind, column) in aggregates.items()],
    )
    shifts = per_slice.select(
        F.col("_slice").alias("_slice_of"),
        *[F.col(g).alias(f"_group_{g}") for g in groups],
        *[kinds[kind](f"_part_{name}").over(earlier).alias(f"_shift_{name}") for name, (kind, _) in aggregates.items()],
        F.count("*").over(earlier).alias("_earlier"),
    ).filter("_earlier > 0").drop("_earlier")  # only the first group of a slice can start earlier

    match = F.col("_slice") == F.col("_slice_of")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    local = rows.select("*", *[kinds[kind](column).over(inside).alias(name) for name, (kind, column) in aggregates.items()])

    def shifted(name: str, kind: str) -> Column:
        shift = F.col(f"_shift_{name}")
        if kind == "sum":
            return F.col(name) + F.coalesce(shift, F.lit(0))
        return F.least(F.col(name), shift)  # least() ignores a missing shift

    return local.join(F.broadcast(shifts), match, "left").select(
        *rows.columns, *[shifted(name, kind).alias(name) for name, (kind, _) in aggregates.items()]
    )


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n) with the rows of each distinct value folded before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))


def mid_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str = "mid_rank") -> DataFrame:
    """(groups, value, n, mid_rank): the average rank that tied values share inside their group."""
    counts = ordered(value_counts(df, groups, value), [*groups, value])
    upto = running(counts, groups, {"_upto": ("sum", "n")})
    return upto.select(*groups, value, "n", (F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).cast("double").alias(name))


FIRST_BUCKETS = 30  # buckets for each doubling of a value in the first round
BUCKETS = 1 << 16  # equal parts of a range in the later ones


def _magnitude(x: Column) -> Column:
    """A whole number that never falls as x rises: sign and binary logarithm in steps; infinities and NaN at the ends."""
    steps = F.floor((F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.log2(F.abs(x)))) + 1101.0) * FIRST_BUCKETS)
    return F.when(F.isnan(x), F.lit(1 << 20)).when(x == 0, F.lit(0)).when(x > 0, steps).otherwise(-steps).cast("int")


def group_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles per group with linear interpolation, plus the number of rows `n`.

    Radix selection: each round counts values in buckets that rise with them, folded per task, and finds the bucket
    that holds a wanted place; the next round looks into these buckets only, until each holds one value. The first
    round's buckets follow the magnitude of values, later ones part a bucket's range evenly, so doubles take four rounds
    at most and columns of few values fewer. Nothing is sorted but a group's buckets, of which there are no more than
    some 130,000 however large the group. Rows with a null value or a null group take no part.
    """
    wanted = list(groups)
    if not groups:  # one group: a settled column, so that joins keep an equality
        groups, df = ["_all"], df.withColumn("_all", F.lit(0))
    present = F.col(value).isNotNull()
    for g in groups:
        present = present & F.col(g).isNotNull()
    # negative zero is the same value as zero
    rows = stored(df.filter(present).select(*groups, (F.col(value).cast("double") + 0.0).alias("_x")))
    buckets = [F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]

    hist = rows.groupBy(*groups, _magnitude(F.col("_x")).alias("_bucket")).agg(*buckets)
    upto = F.sum("_n").over(W.partitionBy(*groups).orderBy("_bucket"))
    counted = hist.select("*", upto.alias("_upto"), F.sum("_n").over(W.partitionBy(*groups)).alias("_size"))
    spots = []
    for name, q in quantiles.items():
        spot = (F.col("_size") - 1) * F.lit(float(q))
        for side, at in (("low", F.floor(spot)), ("high", F.ceil(spot))):
            spots.append(F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"), at.alias("_at"), (spot - F.floor(spot)).alias("_part")))
    inside = F.filter(F.array(*spots), lambda p: (p["_at"] >= F.col("_upto") - F.col("_n")) & (p["_at"] < F.col("_upto")))
    places = stored(counted.select(*groups, "_size", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"), F.inline(inside)))
    open_ = F.col("_lo") < F.col("_hi")
    while n := (left := places.filter(open_)).count():
        ranges = left.select(*groups, "_lo", "_hi", "_below").distinct()
        # few ranges are sent to the values, which then stay where they are
        looked = rows.join(F.broadcast(ranges), list(groups)) if n <= BROADCAST_ROWS else lookup_join(rows, ranges, groups, salts=8)
        looked = looked.filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS))
        keys = [*groups, "_from", "_to"]
        named = looked.select(*groups, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_below", part.alias("_bucket"), "_x")
        upto = F.col("_below") + F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket"))
        counted = named.groupBy(*keys, "_below", "_bucket").agg(*buckets).select("*", upto.alias("_upto"))
        asked = left.select(*groups, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_size", "_name", "_side", "_at", "_part")
        found = asked.join(counted, keys).filter((F.col("_at") >= F.col("_upto") - F.col("_n")) & (F.col("_at") < F.col("_upto")))
        found = found.select(*groups, "_size", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"), "_name", "_side", "_at", "_part")
        places = stored(places.filter(~open_).unionByName(found))

    def picked(name: str, side: str, column: str = "_lo") -> Column:
        return F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col(column)))

    ends = [picked(q, side).alias(f"_{side}_{q}") for q in quantiles for side in ("low", "high")]
    parts = [picked(q, "low", "_part").alias(f"_part_{q}") for q in quantiles]
    chosen = places.groupBy(*groups).agg(F.max("_size").alias("n"), *ends, *parts)
    return chosen.select(
        *wanted,
        "n",
        *[
            F.when(F.col(f"_part_{q}") == 0, F.col(f"_low_{q}"))
            .otherwise(F.col(f"_low_{q}") + F.col(f"_part_{q}") * (F.col(f"_high_{q}") - F.col(f"_low_{q}")))
            .alias(q)
            for q in quantiles
        ],
    )
