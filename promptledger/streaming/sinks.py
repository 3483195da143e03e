"""Replay-safe parquet sinks for foreachBatch, and folders that outlive a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def run_available(stream: DataFrame, mode: str, write: Callable, progress: str) -> list:
    """Process what has arrived since the last run, then stop; returns the progress reports.

    ``write(batch, batch_id)`` stores a batch. ``progress`` is the folder that remembers
    how far earlier runs came; the same folder resumes, another one starts anew.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return list(query.recentProgress)


def batch_writer(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """Store each batch in a folder of its own: a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(f"{path}/batch_id={batch_id}")

    return write


def stored_batches(
    spark: SparkSession, path: str, schema: T.StructType, *partitions: str
) -> DataFrame:
    """All rows stored in a folder with their ``batch_id``; none before the first batch."""
    first = spark.createDataFrame([], schema).write.mode("ignore")
    if partitions:
        first = first.partitionBy(*partitions)
    first.parquet(f"{path}/batch_id=-1")
    numbered = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(numbered).parquet(path)
