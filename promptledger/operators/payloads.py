"""Per-payload measures, costs, warnings and the full payload report.

Input is ``(payload_id, text)`` with an optional ``model``. Everything about one
payload is computed from its own row, so none of these operators shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.expressions.warnings import CODES
from promptledger.settings import DEFAULT_MODEL, DEFAULTS, Thresholds
from promptledger.sources.pricing import PRICES, priced, rate_of, with_rates, with_rates_of


def measures(payloads: DataFrame) -> DataFrame:
    """Token, word and line counts and the projected output of every payload."""
    counted = payloads.withColumns(
        {
            "token_count": fn.token_count("text"),
            "word_count": fn.word_count("text"),
            "line_count": fn.line_count("text"),
        }
    )
    return counted.withColumn("estimated_output", fn.projected_output("token_count")).drop("text")


def symbol_heavy(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    return payloads.select(
        "payload_id", (fn.symbol_share("text") > thresholds.symbol_share).alias("code_heavy")
    )


def cost_by_direction(
    usage: DataFrame, tokens: str, direction: str, prices: DataFrame | None = None
) -> DataFrame:
    """Add ``cost_usd`` for a token column billed in the named direction."""
    rated = with_rates(usage, prices)
    return rated.withColumn("cost_usd", priced(F.col(tokens), rate_of(F.col(direction)))).drop(
        "input_per_1m", "output_per_1m", "cached_per_1m"
    )


def known_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows whose model has a price; the price table's own size decides the join."""
    return usage.join(prices.select("model"), "model", "left_semi")


def unknown_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows whose model has no price."""
    return usage.join(prices.select("model"), "model", "left_anti")


def model_costs(payloads: DataFrame) -> DataFrame:
    """What each payload would cost with each listed model.

    The fixed price list is unrolled inside every row instead of joined.
    """
    rows = F.array(
        *(
            F.struct(
                F.lit(model).alias("model"), F.lit(i).alias("input"), F.lit(o).alias("output")
            )
            for model, (i, o, _) in PRICES.items()
        )
    )
    counted = measures(payloads).select("payload_id", "token_count", "estimated_output")
    each = counted.select("*", F.inline(rows))
    return each.select(
        "payload_id",
        "model",
        priced(F.col("token_count"), F.col("input")).alias("input_cost"),
        priced(F.col("estimated_output"), F.col("output")).alias("output_cost"),
    )


def long_line_rows(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    found = fn.long_lines("text", thresholds.long_line_bytes)
    return payloads.select("payload_id", F.inline(found))


def overfull(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Payloads with more tokens than the context threshold.

    A token takes at least one character, so shorter texts are dropped before counting.
    """
    limit = thresholds.context_tokens
    long_enough = payloads.where(F.length("text") > limit)
    counted = long_enough.select("payload_id", fn.token_count("text").alias("token_count"))
    return counted.where(F.col("token_count") > limit)


def _warnings(thresholds: Thresholds) -> Column:
    return fn.all_warnings(
        "_repeats", "_long", "token_count", "findings", thresholds.context_tokens
    )


def _scanned(payloads: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Rows with repeats, long lines and scrub results.

    The scrub result comes out of a generator, which keeps a later filter on it from
    being pushed down and evaluated a second time.
    """
    others = [c for c in payloads.columns if c != "text"]
    return payloads.select(
        *others,
        fn.token_count("text").alias("token_count"),
        fn.word_count("text").alias("word_count"),
        fn.line_count("text").alias("line_count"),
        fn.duplicate_blocks(
            "text", thresholds.window_lines, thresholds.window_min_words
        ).alias("_repeats"),
        fn.long_lines("text", thresholds.long_line_bytes).alias("_long"),
        F.inline(F.array(fn.scrub("text", None, thresholds.entropy))),
    )


def payload_report(
    payloads: DataFrame,
    thresholds: Thresholds = DEFAULTS,
    prices: DataFrame | None = None,
) -> DataFrame:
    """One row per payload: counts, costs, warnings, findings and a hint."""
    scanned = _scanned(payloads, thresholds)
    tokens = F.col("token_count")
    own_model = "model" in payloads.columns
    described = scanned.select(
        "payload_id",
        *(["model"] if own_model else []),
        "token_count",
        "word_count",
        "line_count",
        fn.projected_output("token_count").alias("estimated_output"),
        _warnings(thresholds).alias("warnings"),
        "findings",
        "has_secrets",
        fn.shortening_hint("token_count", thresholds.hint_tokens).alias("compression_hint"),
    )
    if own_model:
        rated = with_rates(described, prices)
    else:
        rated = with_rates_of(described, DEFAULT_MODEL, prices)
    input_cost = priced(tokens, F.col("input_per_1m"))
    output_cost = priced(F.col("estimated_output"), F.col("output_per_1m"))
    return rated.select(
        "payload_id",
        "model",
        "token_count",
        "word_count",
        "line_count",
        "estimated_output",
        input_cost.alias("input_cost"),
        output_cost.alias("output_cost"),
        (input_cost + output_cost).alias("total_cost"),
        "warnings",
        "findings",
        "has_secrets",
        "compression_hint",
    )


def warning_rows(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """One row per warning, numbered in report order."""
    scanned = _scanned(payloads, thresholds)
    numbered = scanned.select(
        "payload_id", F.posexplode(_warnings(thresholds)).alias("seq", "w")
    )
    return numbered.select("payload_id", (F.col("seq") + 1).alias("seq"), "w.*")


def warning_counts(payloads: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Warnings per payload: the total and one column per code."""
    scanned = _scanned(payloads, thresholds)
    codes = scanned.select("payload_id", _warnings(thresholds)["code"].alias("codes"))

    def count_of(code: str) -> Column:
        return F.expr(f"CAST(size(filter(codes, c -> c = '{code}')) AS BIGINT)")

    return codes.select(
        "payload_id",
        F.size("codes").cast("bigint").alias("warnings"),
        *(count_of(code).alias(code.lower()) for code in CODES),
    )
