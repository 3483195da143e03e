"""Comparison of an original and an optimized version of the same payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.settings import DEFAULT_MODEL
from promptledger.sources.pricing import priced, with_rates, with_rates_of

# Fixed value: the instruction a summarising model is given ahead of the content.
SUMMARY_PROMPT = (
    "Summarise the following content as concisely as possible, preserving all key "
    "information and instructions. Remove redundancy and filler. Output only the "
    "summarised content, no preamble.\n\n---\n",
    "\n---",
)


def _counted(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select(
        "pair_id",
        *more,
        *(["model"] if "model" in pairs.columns else []),
        fn.token_count("original").alias("original_tokens"),
        fn.token_count("optimized").alias("optimized_tokens"),
    )


def pair_delta(
    pairs: DataFrame, model: str = DEFAULT_MODEL, prices: DataFrame | None = None
) -> DataFrame:
    """Tokens and input cost saved by the optimized version; negative when it grew."""
    return _delta(_counted(pairs), model, prices)


def pair_report(
    pairs: DataFrame, model: str = DEFAULT_MODEL, prices: DataFrame | None = None
) -> DataFrame:
    """``pair_delta`` with the removed and the added lines of each pair, sorted."""
    removed = F.array_sort(fn.lines_only_in("original", "optimized")["line"])
    added = F.array_sort(fn.lines_only_in("optimized", "original")["line"])
    counted = _counted(pairs, removed.alias("removed_lines"), added.alias("added_lines"))
    return _delta(counted, model, prices, "removed_lines", "added_lines")


def _delta(counted: DataFrame, model: str, prices: DataFrame | None, *more: str) -> DataFrame:
    if "model" in counted.columns:
        rated = with_rates(counted, prices)
    else:
        rated = with_rates_of(counted, model, prices)
    rate = F.col("input_per_1m")
    before, after = F.col("original_tokens"), F.col("optimized_tokens")
    delta = before - after
    return rated.select(
        "pair_id",
        "model",
        "original_tokens",
        "optimized_tokens",
        delta.alias("token_delta"),
        F.try_divide(delta.cast("double") * 100, before.cast("double")).alias("percent"),
        priced(before, rate).alias("original_cost"),
        priced(after, rate).alias("optimized_cost"),
        (priced(before, rate) - priced(after, rate)).alias("cost_delta"),
        F.when(delta > 0, "saved").when(delta < 0, "added").otherwise("none").alias("outcome"),
        *more,
    )


def compression_outcome(pairs: DataFrame) -> DataFrame:
    """Compressed size as a share of the original one, and tokens saved."""
    before, after = F.col("original_tokens"), F.col("optimized_tokens")
    return _counted(pairs).select(
        "pair_id",
        "original_tokens",
        after.alias("compressed_tokens"),
        F.coalesce(F.try_divide(after.cast("double"), before.cast("double")), F.lit(1.0)).alias(
            "compression_ratio"
        ),
        (before - after).alias("tokens_saved"),
    )


def removed_lines(pairs: DataFrame) -> DataFrame:
    """Lines of the original that the optimized version lacks, with multiplicity."""
    return pairs.select("pair_id", F.inline(fn.lines_only_in("original", "optimized")))


def added_lines(pairs: DataFrame) -> DataFrame:
    """Lines of the optimized version that the original lacks, with multiplicity."""
    return pairs.select("pair_id", F.inline(fn.lines_only_in("optimized", "original")))


def common_lines(pairs: DataFrame) -> DataFrame:
    """Lines kept in both versions, with multiplicity."""
    return pairs.select("pair_id", F.inline(fn.lines_in_both("original", "optimized")))


def compression_requests(payloads: DataFrame, model: str) -> DataFrame:
    """Chat requests that ask a model to summarise each payload, as JSON lines."""
    before, after = SUMMARY_PROMPT
    prompt = F.concat(F.lit(before), F.col("text"), F.lit(after))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(
            F.struct(F.lit("user").alias("role"), prompt.alias("content"))
        ).alias("messages"),
        F.nullif(F.col("max_tokens"), F.lit(0)).alias("max_tokens"),
    )
    counted = payloads.select("payload_id", "text", fn.token_count("text").alias("max_tokens"))
    return counted.select(
        "payload_id", "max_tokens", prompt.alias("prompt"), F.to_json(body).alias("request")
    )
