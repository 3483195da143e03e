"""Scrubbing payloads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.operators.scrubbing import scrubbed
from promptledger.streaming.sinks import batch_writer, run_available, stored_batches

GATED = T.StructType(
    [
        T.StructField("payload_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("findings", T.LongType()),
        T.StructField("blocked", T.BooleanType()),
    ]
)


def stream_scrub(payloads: DataFrame, progress: str, output: str, entropy: float = 4.5) -> DataFrame:
    """Clean text of arriving payloads, kept apart by whether anything was found.

    Stateless. One write per batch puts passed and blocked payloads in folders of their
    own under ``output``, so each payload is scanned once. The folder ``progress``
    remembers what was read: a later run goes on with what has arrived since.
    """
    store = batch_writer(output, "blocked")

    def write(batch: DataFrame, batch_id: int) -> None:
        gated = scrubbed(batch, None, entropy).select(
            "payload_id",
            F.col("clean").alias("text"),
            F.size("findings").cast("bigint").alias("findings"),
            F.col("has_secrets").alias("blocked"),
        )
        store(gated, batch_id)

    stored_batches(payloads.sparkSession, output, GATED, "blocked")
    run_available(payloads, "append", write, progress)
    stored = stored_batches(payloads.sparkSession, output, GATED, "blocked")
    return stored.select(*GATED.fieldNames())
