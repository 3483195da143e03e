"""Budget status, breaches, spend ticks, burn rate and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger.operators.ledger import tokens_total
from promptledger.plans.ordered import running_sums
from promptledger.plans.storage import stored
from promptledger.settings import DEFAULTS, Thresholds
from promptledger.sources.pricing import USD, exact

DAY_SECONDS = 24 * 60 * 60
PROJECTION_HOURS = 8


def used_percent(spend: Column, limit: float) -> Column:
    """Spend as a percentage of the limit; 0 when there is no limit."""
    if limit <= 0:
        return F.lit(0.0)
    return spend / F.lit(float(limit)) * F.lit(100.0)


def state_of(percent: Column, thresholds: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(percent >= 100, "exceeded")
        .when(percent >= thresholds.warn_percent, "warn")
        .otherwise("ok")
    )


def must_stop(percent: Column, thresholds: Thresholds = DEFAULTS) -> Column:
    return (percent >= 100) & F.lit(thresholds.hard_stop)


def budget_status(daily: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Spend, limit and used percentage per day."""
    spend = F.col("cost_usd")
    return daily.select(
        "date",
        spend.alias("spend_usd"),
        F.lit(float(thresholds.daily_limit)).alias("limit_usd"),
        used_percent(spend, thresholds.daily_limit).alias("used_percent"),
        F.col("tokens_total").alias("tokens_today"),
    )


def budget_state(daily: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Budget status with its state and whether work must stop."""
    percent = F.col("used_percent")
    return budget_status(daily, thresholds).withColumns(
        {"state": state_of(percent, thresholds), "stop": must_stop(percent, thresholds)}
    )


def _spending(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("ended_at").isNotNull()).select(
        "id", "ended_at", "cost_usd", F.to_date("ended_at").alias("date")
    )


def first_breach(sessions: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """The session at which a day's running spend first reaches each budget level.

    Spend is summed by minute first. That gives the minute each level falls in, at most
    1,440 rows a day to scan, and only the sessions of those minutes are then put in
    order. Crossing minutes are at most two rows a day, which bounds the broadcast.
    """
    levels = F.array(
        F.struct(
            F.lit("warn").alias("level"), F.lit(float(thresholds.warn_percent)).alias("percent")
        ),
        F.struct(F.lit("exceeded").alias("level"), F.lit(100.0).alias("percent")),
    )
    spending = _spending(sessions).withColumn("minute", F.date_trunc("minute", "ended_at"))
    minutes = spending.groupBy("date", "minute").agg(
        F.sum(exact(F.col("cost_usd"))).cast(USD).alias("spent")
    )
    so_far = (
        Window.partitionBy("date")
        .orderBy("minute")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    limit = thresholds.daily_limit

    def reached(amount: Column) -> Column:
        return used_percent(amount.cast("double"), limit) >= F.col("percent")

    crossing = (
        minutes.withColumn("upto", F.sum("spent").over(so_far).cast(USD))
        .withColumn("before", F.col("upto") - F.col("spent"))
        .select("date", "minute", "before", "upto", F.inline(levels))
        .where(reached(F.col("upto")) & ~reached(F.col("before")))
        .drop("upto")
    )
    candidates = spending.join(crossing, ["date", "minute"])
    summed = running_sums(
        candidates, ["date", "level"], ["ended_at", "id"], {"spent": "cost_usd"}
    )
    spend = F.col("before") + F.col("spent")
    return (
        summed.where(reached(spend))
        .groupBy("date", "level")
        .agg(
            F.min(F.struct("ended_at", "id", spend.cast("double").alias("spend_usd"))).alias(
                "first"
            )
        )
        .select("date", "level", "first.id", "first.ended_at", "first.spend_usd")
    )


#: Calendar days that ticks may span; a mistaken date fails instead of making more.
MOST_DAYS = 36_600


def tick_of(at: str, width_seconds: int) -> Column:
    """The number of the slice of its day that a time falls in."""
    if DAY_SECONDS % width_seconds:
        raise ValueError("the tick width must divide a day")
    second = F.unix_timestamp(at) - F.unix_timestamp(F.date_trunc("day", at))
    return F.floor(second / F.lit(width_seconds)).cast("int")


def tick_totals(sessions: DataFrame, width_seconds: int) -> DataFrame:
    """Spend and tokens per tick, a slice of the day of fixed width."""
    ended = sessions.where(F.col("ended_at").isNotNull())
    date = F.to_date("ended_at")
    return ended.groupBy(date.alias("date"), tick_of("ended_at", width_seconds).alias("tick")).agg(
        F.sum(exact(F.col("cost_usd"))).cast(USD).alias("spent"), F.sum(tokens_total()).alias("tokens")
    )


def ticks_from(totals: DataFrame, width_seconds: int, days: DataFrame | None = None) -> DataFrame:
    """Spend of the day so far at the end of every tick of every calendar day, or of the
    given days (date).

    Works on the totals, at most one row per tick, so nothing here grows with the
    number of sessions.
    """
    last = DAY_SECONDS // width_seconds - 1
    if days is None:
        days = calendar_days(totals)
    grid = days.repartition("date").select("date", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tick"))
    upto = (
        Window.partitionBy("date").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    )
    zero = F.lit(0).cast(USD)
    return grid.join(totals, ["date", "tick"], "left").select(
        "date",
        "tick",
        F.sum(F.coalesce("spent", zero)).over(upto).cast(USD).alias("spend"),
        F.sum(F.coalesce("tokens", F.lit(0))).over(upto).alias("tokens_today"),
    )


def calendar_days(totals: DataFrame) -> DataFrame:
    """All days from the first to the last of the totals."""
    span = totals.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    too_long = F.raise_error(F.concat(F.lit("ticks of more days than allowed: "), "lo", F.lit(" to "), "hi"))
    days = F.when(F.datediff("hi", "lo") < MOST_DAYS, F.expr("sequence(lo, hi, interval 1 day)")).otherwise(
        too_long.cast("array<date>")
    )
    # One row makes the days; dealt out, many tasks make their ticks.
    return span.where("lo IS NOT NULL").select(F.explode(days).alias("date"))


def burn_from(ticks: DataFrame, width_seconds: int) -> DataFrame:
    """USD per hour since the tick before; 0 unless the spend grew.

    The first tick of a day follows the last one of the day before. Its value is joined
    from the day totals, so the ordering stays inside a day.
    """
    within = Window.partitionBy("date").orderBy("tick")
    day_ends = ticks.groupBy("date").agg(F.max("spend").alias("day_total"))
    yesterday = day_ends.select(F.date_add("date", 1).alias("date"), "day_total")
    joined = ticks.join(yesterday, "date", "left")
    previous = F.coalesce(
        F.lag("spend").over(within), F.when(F.col("tick") == 0, F.col("day_total"))
    )
    spend = F.col("spend")
    hours = F.lit(width_seconds / 3600.0)
    burn = F.when(spend > previous, (spend - previous).cast("double") / hours)
    return joined.select(
        "date",
        "tick",
        "spend",
        "tokens_today",
        F.coalesce(burn, F.lit(0.0)).alias("burn_usd_per_hour"),
    )


def spend_ticks(sessions: DataFrame, width_seconds: int = 3600) -> DataFrame:
    """Running day spend at each tick."""
    ticks = ticks_from(stored(tick_totals(sessions, width_seconds), "ticks"), width_seconds)
    return ticks.withColumn("spend_usd", F.col("spend").cast("double")).drop("spend")


def burn_rate(sessions: DataFrame, width_seconds: int = 3600) -> DataFrame:
    """Running day spend and burn rate at each tick."""
    ticks = ticks_from(stored(tick_totals(sessions, width_seconds), "ticks"), width_seconds)
    burned = burn_from(ticks, width_seconds)
    return burned.withColumn("spend_usd", F.col("spend").cast("double")).drop("spend")


def projected() -> Column:
    """Spend eight hours on at the current burn rate; null while nothing burns."""
    burn = F.col("burn_usd_per_hour")
    return F.when(burn > 0, F.col("spend_usd") + burn * F.lit(float(PROJECTION_HOURS)))


def burn_projection(sessions: DataFrame, width_seconds: int = 3600) -> DataFrame:
    return burn_rate(sessions, width_seconds).withColumn("projected_usd", projected())


def alerts_from(burned: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Ticks with budget percentage, state, stop flag and projection."""
    percent = used_percent(F.col("spend_usd"), thresholds.daily_limit)
    return burned.withColumns(
        {
            "used_percent": percent,
            "state": state_of(percent, thresholds),
            "stop": must_stop(percent, thresholds),
            "projected_usd": projected(),
        }
    )


def session_budget(sessions: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Spend so far of each tag at every session, against the session limit."""
    ended = sessions.where(F.col("ended_at").isNotNull()).select(
        "tag", "id", "ended_at", "cost_usd"
    )
    summed = running_sums(ended, ["tag"], ["ended_at", "id"], {"spent": "cost_usd"})
    spent = F.col("spent").cast("double")
    percent = used_percent(spent, thresholds.session_limit)
    return summed.select(
        "tag",
        "id",
        spent.alias("spent_usd"),
        percent.alias("used_percent"),
        state_of(percent, thresholds).alias("state"),
    )
