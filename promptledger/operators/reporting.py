"""Session reports: cache metrics, totals, attribution and savings over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger.operators.ledger import tokens_total
from promptledger.sources.pricing import USD, exact, priced, total, with_rates


def cache_hit_ratio() -> Column:
    """Cached tokens as a share of all input; 0 without input."""
    read = (F.col("tokens_in") + F.col("tokens_cached")).cast("double")
    return F.coalesce(F.try_divide(F.col("tokens_cached").cast("double"), read), F.lit(0.0))


def cache_savings() -> Column:
    """What the cached tokens would have cost on top at the full input rate."""
    return priced(F.col("tokens_cached"), F.col("input_per_1m") - F.col("cached_per_1m"))


def session_report(sessions: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Sessions with cache hit ratio and realised cache savings."""
    rated = with_rates(sessions, prices)
    return rated.withColumns(
        {"cache_hit_ratio": cache_hit_ratio(), "cache_savings_usd": cache_savings()}
    ).drop("input_per_1m", "output_per_1m", "cached_per_1m")


def report_total(report: DataFrame) -> DataFrame:
    """Total cost and savings; no row unless there is more than one session."""
    summed = report.agg(
        total(F.col("cost_usd")).alias("cost_usd"),
        total(F.col("cache_savings_usd")).alias("cache_savings_usd"),
        F.count(F.lit(1)).alias("sessions"),
    )
    return summed.where("sessions > 1")


def _attributed(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(tokens_total()).alias("tokens_total"),
        total(F.col("cost_usd")).alias("cost_usd"),
        total(F.col("cache_savings_usd")).alias("cache_savings_usd"),
    )


def cost_by(report: DataFrame, *columns: str) -> DataFrame:
    """Tokens, cost and savings per group."""
    return _attributed(report.groupBy(*columns))


def cost_rollup(report: DataFrame, *columns: str) -> DataFrame:
    """Cost per group with subtotals from right to left."""
    return _attributed(report.rollup(*columns))


def cost_cube(report: DataFrame, *columns: str) -> DataFrame:
    """Cost per group with subtotals for every combination of columns."""
    return _attributed(report.cube(*columns))


def with_end_day(report: DataFrame) -> DataFrame:
    ended = report.where(F.col("ended_at").isNotNull())
    return ended.withColumn("date", F.to_date("ended_at"))


def savings_vs_baseline(report: DataFrame) -> DataFrame:
    """Actual against uncached cost by day, and the savings so far.

    Sessions are reduced to days first; the ordered sum then runs over one row a day.
    """
    days = with_end_day(report).groupBy("date").agg(
        F.sum(exact(F.col("cost_usd"))).cast(USD).alias("actual"),
        F.sum(exact(F.col("cache_savings_usd"))).cast(USD).alias("saved"),
    )
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        "date",
        F.col("actual").cast("double").alias("actual_usd"),
        (F.col("actual") + F.col("saved")).cast("double").alias("baseline_usd"),
        F.col("saved").cast("double").alias("saved_usd"),
        F.sum("saved").over(so_far).cast("double").alias("saved_to_date_usd"),
    )
