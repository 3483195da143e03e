"""The session ledger: folding events, daily spend, lookup and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.operators.payloads import payload_report
from promptledger.settings import DEFAULTS, Thresholds
from promptledger.sources.pricing import total, with_rates
from promptledger.sources.tables import SESSION_SCHEMA


def tokens_total():
    return F.col("tokens_in") + F.col("tokens_out") + F.col("tokens_cached")


def with_cost(sessions: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add what a session's tokens cost with its model."""
    rated = with_rates(sessions, prices)
    amount = (
        F.col("tokens_in") * F.col("input_per_1m")
        + F.col("tokens_out") * F.col("output_per_1m")
        + F.col("tokens_cached") * F.col("cached_per_1m")
    ) / F.lit(1_000_000)
    return rated.withColumn("cost_usd", amount).drop(
        "input_per_1m", "output_per_1m", "cached_per_1m"
    )


def fold_sessions(events: DataFrame) -> DataFrame:
    """Start, analysis and end events folded into one row per session.

    The last end of a session wins, so a session that is ended twice counts once. The
    fold is a plain aggregate and combines ahead of the shuffle.
    """
    kind = F.col("kind")

    def last(column: str, of: str):
        return F.max_by(column, F.when(kind == of, F.struct("at", "event_no")))

    start, end = kind == "start", kind == "end"
    folded = events.groupBy("id").agg(
        F.max(F.when(start, F.col("session_uuid"))).alias("session_uuid"),
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(end, F.col("at"))).alias("ended_at"),
        F.coalesce(F.max(F.when(start, F.col("model"))), F.lit("")).alias("model"),
        F.coalesce(F.max(F.when(start, F.col("tag"))), F.lit("")).alias("tag"),
        F.coalesce(last("tokens_in", "end"), F.lit(0)).alias("tokens_in"),
        F.coalesce(last("tokens_out", "end"), F.lit(0)).alias("tokens_out"),
        F.coalesce(last("tokens_cached", "end"), F.lit(0)).alias("tokens_cached"),
        F.coalesce(last("cost_usd", "end"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(last("warning_count", "analysis"), F.lit(0)).alias("warning_count"),
    )
    return folded.withColumn("notes", F.lit(""))


def session_by_id(sessions: DataFrame, session_id: int) -> DataFrame:
    return sessions.where(F.col("id") == session_id)


def last_session(sessions: DataFrame) -> DataFrame:
    """The session with the greatest id; no row for an empty ledger."""
    return sessions.orderBy(F.desc("id")).limit(1)


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("id"))


def select_sessions(
    sessions: DataFrame, which: str | int = "last", tag: str | None = None
) -> DataFrame:
    """The sessions to report, of one tag if given: ``"all"`` newest first, ``"last"``, or
    one id."""
    if tag is not None:
        sessions = sessions.where(F.col("tag") == tag)
    if which == "all":
        return newest_first(sessions)
    if which in ("last", ""):
        return last_session(sessions)
    return session_by_id(sessions, int(which))


def daily_spend(sessions: DataFrame) -> DataFrame:
    """Cost and tokens of ended sessions by the day they ended."""
    ended = sessions.where(F.col("ended_at").isNotNull())
    return ended.groupBy(F.to_date("ended_at").alias("date")).agg(
        total(F.col("cost_usd")).alias("cost_usd"),
        F.sum(tokens_total()).alias("tokens_total"),
    )


def upsert_daily(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add new daily rows to stored ones, measure by measure."""
    return (
        stored.unionByName(new)
        .groupBy("date")
        .agg(
            total(F.col("cost_usd")).alias("cost_usd"),
            F.sum("tokens_total").alias("tokens_total"),
        )
    )


def reset_days(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Remove the rows of the given days."""
    return daily.join(days.select("date").distinct(), "date", "left_anti")


def spend_on(daily: DataFrame, days: DataFrame) -> DataFrame:
    """The spend of each requested day; zero where there is none."""
    joined = days.select("date").join(daily, "date", "left")
    return joined.select(
        "date",
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"),
    )


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new ledger rows in one table: columns an older ledger lacks are added."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("warning_count", F.coalesce("warning_count", F.lit(0)))


def duplicate_keys(sessions: DataFrame) -> DataFrame:
    """Session keys that occur more than once; sessions without a key are exempt."""
    keyed = sessions.where(F.col("session_uuid").isNotNull())
    counted = keyed.groupBy("session_uuid").agg(F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1")


def analysis_sessions(
    payloads: DataFrame, tag: str, thresholds: Thresholds = DEFAULTS, at=None
) -> DataFrame:
    """Each analysed payload as a finished ledger session."""
    when = F.current_timestamp() if at is None else at
    report = payload_report(payloads, thresholds)
    key = F.sha2(F.concat_ws(":", F.lit(tag), F.col("payload_id").cast("string")), 256)
    rows = report.select(
        F.col("payload_id").alias("id"),
        key.alias("session_uuid"),
        when.alias("started_at"),
        when.alias("ended_at"),
        "model",
        F.lit(tag).alias("tag"),
        F.col("token_count").alias("tokens_in"),
        F.col("estimated_output").alias("tokens_out"),
        F.lit(0).cast("bigint").alias("tokens_cached"),
        F.col("total_cost").alias("cost_usd"),
        F.size("warnings").cast("bigint").alias("warning_count"),
        F.lit("").alias("notes"),
    )
    return rows.select(*SESSION_SCHEMA.fieldNames())

