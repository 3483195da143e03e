"""Finding, redacting and gating secrets over a table of payloads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.expressions.secrets import HIGH_ENTROPY, PATTERN_TYPES


def redacted(payloads: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """Payloads with secrets replaced by labels."""
    return payloads.withColumn("text", fn.redact("text", types))


def scrubbed(
    payloads: DataFrame, types: Iterable[str] | None = None, entropy: float = 4.5
) -> DataFrame:
    """``(payload_id, clean, findings, has_secrets)``, scanned once per payload."""
    return payloads.select(
        "payload_id", F.inline(F.array(fn.scrub("text", types, entropy)))
    )


def finding_rows(
    payloads: DataFrame, types: Iterable[str] | None = None, entropy: float = 4.5
) -> DataFrame:
    """One row per finding, numbered in the order of detection.

    The generator takes the expression itself: exploding a column would add a filter on
    that column, and the scan would run again for it.
    """
    found = fn.scrub("text", types, entropy)["findings"]
    numbered = payloads.select("payload_id", F.posexplode(found).alias("seq", "f"))
    return numbered.select("payload_id", (F.col("seq") + 1).alias("seq"), "f.*")


def high_entropy_rows(payloads: DataFrame, entropy: float = 4.5) -> DataFrame:
    """High-entropy words left after redaction."""
    clean = payloads.select("payload_id", fn.redact("text").alias("clean"))
    return clean.select("payload_id", F.inline(fn.high_entropy_findings("clean", entropy)))


def passed(payloads: DataFrame, entropy: float = 4.5) -> DataFrame:
    """Payloads without any finding."""
    return scrubbed(payloads, None, entropy).where(~F.col("has_secrets"))


def blocked(payloads: DataFrame, entropy: float = 4.5) -> DataFrame:
    """Payloads with at least one finding, in clean form."""
    return scrubbed(payloads, None, entropy).where("has_secrets")


def findings_by_type(payloads: DataFrame, entropy: float = 4.5) -> DataFrame:
    """Findings and payloads by type.

    Counts are taken inside each row first, so the aggregation shuffles one row per
    type and task and needs no distinct count.
    """
    counts = ", ".join(
        f"named_struct('type', '{kind}', 'n', size(filter(findings, f -> f.type = '{kind}')))"
        for kind in (*PATTERN_TYPES, HIGH_ENTROPY)
    )
    found = scrubbed(payloads, None, entropy).select(F.inline(F.expr(f"array({counts})")))
    return (
        found.where("n > 0")
        .groupBy("type")
        .agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("payloads"))
    )
