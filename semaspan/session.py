"""Session helpers: where settled and stored tables live, and a local session for tests and benchmarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "semaspan", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # the call sites of columns are kept for messages only, and cost a good part of building a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in `spark.checkpoint.dir`; without that setting it lies below the session's warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled").rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written rows and their order.

    Plans that read the same ordered rows more than once start from a settled table, so that a
    lost executor cannot make two readers see two different orders.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back; later readers prune its columns."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
