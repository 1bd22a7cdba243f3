"""Scans of inputs with fewer splits than the cluster has cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small scan; a large one already has more splits than cores.

    Such an input is no larger than cores * maxPartitionBytes, so the one shuffle it costs is small
    against parsing its text on a few cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
