"""Repeated blocks within payloads and across the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.plans.storage import stored
from promptledger.settings import DEFAULTS, Thresholds


def duplicate_rows(
    payloads: DataFrame, thresholds: Thresholds = DEFAULTS, min_gap: int = 1
) -> DataFrame:
    """``(payload_id, first_line, repeat_line)`` for each repeat inside a payload."""
    found = fn.duplicate_blocks(
        "text", thresholds.window_lines, thresholds.window_min_words, min_gap
    )
    return payloads.select("payload_id", F.inline(found))


def hashed_blocks(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """One row per payload and distinct window: hashes, first line and copies.

    Text ends here; only 128-bit keys and positions travel further.
    """
    found = fn.payload_blocks("text", thresholds.window_lines, thresholds.window_min_words)
    return payloads.select("payload_id", F.inline(found))


def shared_blocks(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Windows that occur more than once in the corpus, one row per window.

    Each payload adds one row per window, so payloads are counted without a distinct,
    and boilerplate found everywhere is combined before the shuffle. The aggregates hold
    plain numbers, which keeps them in a hash table; a struct would force a sort.
    """
    return block_totals(hashed_blocks(payloads, thresholds)).where("occurrences > 1")


def block_totals(blocks: DataFrame) -> DataFrame:
    """One row per window of hashed blocks: its first holder, holders and occurrences."""
    grouped = blocks.groupBy("key", "key2").agg(
        F.min("payload_id").alias("first_payload"),
        F.min_by("first_line", "payload_id").alias("first_line"),
        F.count(F.lit(1)).alias("payloads"),
        F.sum("copies").alias("occurrences"),
    )
    return grouped.select(
        "key",
        "key2",
        "first_payload",
        "first_line",
        "payloads",
        "occurrences",
    )


def shared_block_members(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Every payload that holds a corpus-wide repeated window, with its first holder.

    Windows are hashed once; keys and positions are stored. So is the much smaller shared
    side: a join of two stored tables is one whose hot keys adaptive execution can split,
    so a block that sits in a third of all payloads is joined by many tasks.
    """
    members = stored(hashed_blocks(payloads, thresholds), "blocks")
    shared = stored(block_totals(members).where("payloads > 1"), "shared-blocks")
    joined = members.join(shared.withColumnRenamed("first_line", "source_line"), ["key", "key2"])
    return joined.select(
        "payload_id", "first_line", "copies", "first_payload", "source_line", "payloads"
    )


def compacted(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Payloads without repeated blocks, with the tokens that saves."""
    shorter = fn.compact_text("text", thresholds.window_lines, thresholds.window_min_words)
    both = F.struct(F.col("text").alias("original"), shorter.alias("text"))
    rewritten = payloads.select("payload_id", F.inline(F.array(both)))
    sized = rewritten.select(
        "payload_id",
        "text",
        fn.token_count("original").alias("original_tokens"),
        fn.token_count("text").alias("compacted_tokens"),
    )
    return sized.withColumn(
        "tokens_saved", F.col("original_tokens") - F.col("compacted_tokens")
    )
