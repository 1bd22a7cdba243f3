"""Count only what is new in a corpus folder that keeps growing.

The stream's checkpoint remembers which files were processed, the way a list of excluded paths does
for a batch run, and survives a lost driver. Each batch writes partial counts into its own folder, so
a repeated batch replaces its own part and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspan.operators.vocabulary import token_frequencies


def count_new_files(spark: SparkSession, corpus: str, counts: str, checkpoint: str,
                    max_files: int | None = None) -> None:
    """Add token counts of the files in `corpus` that no earlier run has seen, then stop."""
    source = spark.readStream.format("text")
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)

    def keep_partial_counts(batch: DataFrame, batch_id: int) -> None:
        token_frequencies(batch).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    query = (
        source.load(corpus).writeStream.foreachBatch(keep_partial_counts)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def accumulated_counts(spark: SparkSession, counts: str) -> DataFrame:
    """(lemma_pos, freq) over all batches so far."""
    return spark.read.parquet(counts).groupBy("lemma_pos").agg(F.sum("freq").alias("freq"))
