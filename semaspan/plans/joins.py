"""Joins of a large stream of rows with a table of looked-up keys."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast table holds at most this many rows (short keys and a few numbers, some tens of MB).
BROADCAST_ROWS = 200_000


def lookup_join(
    stream: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    salts: int = 1,
) -> DataFrame:
    """Join `stream` with `table`, choosing the plan from what is known about the table's size.

    max_rows: an upper bound that holds by construction (a limit, a basis dimension). Up to
        BROADCAST_ROWS the table is broadcast and the stream does not move. The bound is checked while
        the table is read: one row more and the query fails instead of sending a large table.
    salts: without such a bound both sides are shuffled. Give salts > 1 when few keys can hold a
        large share of the stream: its rows are spread over sub-keys by a hash of their other columns
        (by place, if they have none), and the table is repeated once for each sub-key. There are at least `salts` of them, more where
        the session has many shuffle partitions.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        return stream.join(F.broadcast(at_most(table, max_rows)), keys, how)
    if salts <= 1:
        return stream.join(table, keys, how)
    salts = max(salts, int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    others = [c for c in stream.columns if c not in keys]
    # rows of nothing but the key are told apart by their places
    spread = F.xxhash64(*others) if others else F.monotonically_increasing_id()
    salted = stream.withColumn("_salt", F.pmod(spread, F.lit(salts)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def at_most(table: DataFrame, max_rows: int) -> DataFrame:
    """`table`, failing as it is read if it holds more rows than promised."""
    # in the one partition that the bounded rows fit, these numbers count them
    row = F.monotonically_increasing_id()
    broken = F.raise_error(F.lit(f"a table of at most {max_rows} rows was promised, and it holds more"))
    return table.limit(max_rows + 1).coalesce(1).filter(F.when(row < max_rows, True).otherwise(broken.cast("boolean")))


def listed(table: DataFrame, max_rows: int | None, key: str = "lemma_pos") -> pa.Table | None:
    """A table whose bound can be promised, as it is sent to the tasks; none if a key is listed twice."""
    if max_rows is None or max_rows > BROADCAST_ROWS:
        return None
    rows = at_most(table, max_rows).toArrow().filter(pc.field(key).is_valid()).combine_chunks()
    return rows if len(pc.unique(rows[key])) == len(rows) else None
