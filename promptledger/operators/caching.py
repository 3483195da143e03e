"""Cache-friendly sections of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.expressions.sections import DYNAMIC, SAVED_ANTHROPIC, SAVED_OPENAI, STABLE


def label_rows(payloads: DataFrame) -> DataFrame:
    """Every line with its label: ``(payload_id, line, type, content)``."""
    return payloads.select("payload_id", F.inline(fn.line_labels("text")))


def section_rows(payloads: DataFrame) -> DataFrame:
    """One row per section, numbered from 1 within its payload."""
    numbered = payloads.select(
        "payload_id", F.posexplode(fn.section_list("text")).alias("no", "s")
    )
    return numbered.select("payload_id", (F.col("no") + 1).alias("section_no"), "s.*")


def cache_analysis(payloads: DataFrame) -> DataFrame:
    """Sections, totals, savings, reorder flag and recommendations, one row per payload."""
    listed = F.struct(fn.section_list("text").alias("sections"))
    found = payloads.select("payload_id", F.inline(F.array(listed)))
    totals = found.select(
        "payload_id",
        F.size("sections").cast("bigint").alias("section_count"),
        fn.tokens_of("sections", STABLE).alias("stable_tokens"),
        fn.tokens_of("sections", DYNAMIC).alias("dynamic_tokens"),
        fn.reorder_needed("sections").alias("reorder_recommended"),
        "sections",
    )
    return with_savings(totals)


def with_savings(totals: DataFrame) -> DataFrame:
    """Add savings and recommendations to section totals."""
    return totals.withColumns(
        {
            "savings_anthropic_usd": fn.saved("stable_tokens", SAVED_ANTHROPIC),
            "savings_openai_usd": fn.saved("stable_tokens", SAVED_OPENAI),
            "recommendations": fn.recommendations(
                "stable_tokens", "dynamic_tokens", "reorder_recommended"
            ),
        }
    )
