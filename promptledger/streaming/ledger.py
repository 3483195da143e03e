"""Continuous ledger: ended sessions, daily spend, ticks with alerts.

1. Arriving sessions are stored batch by batch, each with its newest end there. A clock, the newest end seen
   before a batch, tells which of them come too late: these are kept and counted apart.
2. A second stream reads what was in time. Its state holds the newest end of each session
   until no correction can come any more, and puts out changes: a corrected session takes
   back its old end and adds the new one; an exact repeat or an older end changes nothing.
3. The changes of a batch are summed by tick and added to the days they touch.

No step reads earlier batches again, so a batch costs what it holds and what its days hold.
``progress`` is the folder that remembers what was read: a later run goes on where the last
one stopped. What it stores lies under ``output``, which belongs to that progress folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from promptledger.operators.budget import DAY_SECONDS, alerts_from, burn_from, projected, tick_of, ticks_from
from promptledger.operators.ledger import tokens_total
from promptledger.settings import DEFAULTS, Thresholds
from promptledger.sources.pricing import USD, exact
from promptledger.sources.tables import SESSION_SCHEMA
from promptledger.streaming.days import Alternating, DayTable, add_deltas
from promptledger.streaming.sinks import run_available, stored_batches

SESSIONS, CLOCK, TICKS, ALERTS = "sessions", "clock", "ticks", "alerts"
CLOCK_COLUMNS = "newest TIMESTAMP, rows BIGINT, late_rows BIGINT"
LATE = "late"
CHANGES = "end_micros BIGINT, cost_usd DOUBLE, tokens BIGINT, sign INT"
STATE = "ids BINARY, ends BINARY, costs BINARY, tokens BINARY"
#: States that sessions are kept in.
BUCKETS = 256
MEASURES = [
    T.StructField("tick", T.IntegerType()),
    T.StructField("spent", T.DecimalType(28, 10)),
    T.StructField("tokens", T.LongType()),
    T.StructField("sessions", T.LongType()),
]


@dataclass(frozen=True)
class Lateness:
    """How long after the newest end an end may still arrive, and how long after a session's
    end, in the time of the ends, a correction of it is known as one."""

    arrival: timedelta = timedelta(days=7)
    correction: timedelta = timedelta(days=30)


IN_TIME = Lateness()


def stream_arrivals(sessions: DataFrame, progress: str, output: str, lateness: Lateness = IN_TIME) -> list:
    """Store the ended sessions of a stream; those that come too late in a folder apart."""
    spark = sessions.sparkSession
    clock = Alternating(spark, f"{output}/{CLOCK}", CLOCK_COLUMNS, progress)
    names = SESSION_SCHEMA.fieldNames()

    def write(batch: DataFrame, batch_id: int) -> None:
        before = clock.rows(before=batch_id)[1]
        newest, rows, late_rows = (before[0].newest, before[0].rows, before[0].late_rows) if before else (None, 0, 0)
        late = F.col("ended_at") <= F.lit(newest - lateness.arrival) if newest else F.lit(False)
        path = f"{output}/{SESSIONS}/batch_id={batch_id}"
        # An id that ends often in a batch is one row of each task before it is shuffled.
        rank = F.struct("ended_at", "cost_usd")
        newest_of_id = batch.groupBy("id", late.alias(LATE)).agg(F.max_by(F.struct(*names), rank).alias("s"))
        newest_of_id.select("s.*", LATE).write.mode("overwrite").partitionBy(LATE).parquet(path)
        stored = spark.read.schema(T.StructType([*SESSION_SCHEMA, T.StructField(LATE, T.BooleanType())])).parquet(path)
        seen = stored.agg(F.max("ended_at").alias("newest"), F.count("*").alias("rows"), F.count_if(LATE).alias("late")).first()
        clock.write(batch_id, [(max(filter(None, (newest, seen.newest)), default=None), rows + seen.rows, late_rows + seen.late)])

    _batches(spark, output)
    return run_available(sessions.where(F.col("ended_at").isNotNull()), "append", write, f"{progress}/arrivals")


def _batches(spark: SparkSession, output: str) -> DataFrame:
    late = T.StructType([*SESSION_SCHEMA, T.StructField(LATE, T.BooleanType())])
    return stored_batches(spark, f"{output}/{SESSIONS}", late, LATE)


def late_sessions(spark: SparkSession, output: str) -> DataFrame:
    """Ended sessions that came too late to count."""
    return _batches(spark, output).where(LATE).drop(LATE, "batch_id")


def late_count(spark: SparkSession, progress: str, output: str) -> tuple[int, int]:
    """How many sessions have arrived, and how many of them too late."""
    rows = Alternating(spark, f"{output}/{CLOCK}", CLOCK_COLUMNS, progress).rows()[1]
    return (rows[0].rows, rows[0].late_rows) if rows else (0, 0)


def newest_ends(sessions: DataFrame, *later: str) -> DataFrame:
    """One row per id: the newest end, of equal ends the one later by the given columns."""
    order = [F.col(c).desc() for c in ("ended_at", *later, "cost_usd")]
    numbered = sessions.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return numbered.where("_n = 1").drop("_n")


def stored_sessions(spark: SparkSession, output: str) -> DataFrame:
    """The ended sessions that streams have stored in time, each id once."""
    return newest_ends(_batches(spark, output).where(f"NOT {LATE}"), "batch_id").drop("batch_id", LATE)


def stream_unique_sessions(
    sessions: DataFrame, progress: str, output: str, lateness: Lateness = IN_TIME
) -> DataFrame:
    """Ended sessions of a stream, each id with its newest end."""
    stream_arrivals(sessions, progress, output, lateness)
    return stored_sessions(sessions.sparkSession, output)


def changed_ends(sessions: DataFrame, lateness: Lateness = IN_TIME) -> DataFrame:
    """Changes of the newest end of each session of a stream: its cost and tokens with sign
    -1 for the end that no longer counts, and 1 for the one that does.

    Sessions are kept in ``BUCKETS`` states by a hash of their id, as arrays sorted by it, so
    Python works on arrays and not on single sessions. A state loses the sessions that cannot
    be corrected any more.
    """
    keep = int(lateness.correction.total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Ends.read(state.get) if state.exists else Ends.none()
        if state.hasTimedOut:
            changes = None
        else:
            new = pd.concat(list(frames))
            order = np.lexsort((new.cost_usd, new.batch_id, new.end_micros, new.id))
            held, changes = held.renewed(Ends(*(new[c].to_numpy()[order] for c in ENDS)))
        held = held.after((state.getCurrentWatermarkMs() - keep) * 1000)
        if len(held.ids):
            state.update(held.written())
            state.setTimeoutTimestamp(max(int(held.ends.min()) // 1000 + keep, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if changes is not None and len(changes):
            yield changes

    ends = sessions.withWatermark("ended_at", f"{int(lateness.arrival.total_seconds()) + 1} seconds").select(
        F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.coalesce("id", F.lit(-(2**63))).alias("id"),
        "ended_at",
        F.unix_micros("ended_at").alias("end_micros"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce(tokens_total(), F.lit(0)).alias("tokens"),
        "batch_id",
    )
    return ends.groupBy("bucket").applyInPandasWithState(
        update, CHANGES, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


ENDS = ("id", "end_micros", "cost_usd", "tokens")


@dataclass
class Ends:
    """Newest ends of sessions, sorted by id."""

    ids: np.ndarray
    ends: np.ndarray
    costs: np.ndarray
    tokens: np.ndarray

    @classmethod
    def none(cls) -> Ends:
        return cls(*(np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64, np.int64)))

    @classmethod
    def read(cls, state: tuple) -> Ends:
        kinds = (np.int64, np.int64, np.float64, np.int64)
        return cls(*(np.frombuffer(bytes(raw), kind) for raw, kind in zip(state, kinds, strict=True)))

    def written(self) -> tuple:
        return tuple(column.tobytes() for column in self._columns())

    def _columns(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.ends, self.costs, self.tokens

    def at(self, rows: np.ndarray) -> Ends:
        return Ends(*(column[rows] for column in self._columns()))

    def after(self, micros: int) -> Ends:
        return self.at(self.ends > micros)

    def renewed(self, new: Ends) -> tuple[Ends, pd.DataFrame]:
        """With new ends, in order of id and of what counts more; and the changes."""
        new = new.at(np.append(new.ids[1:] != new.ids[:-1], True))
        place = np.searchsorted(self.ids, new.ids)
        known = np.append(self.ids, 0)[np.minimum(place, len(self.ids))] == new.ids
        known &= place < len(self.ids)
        old = self.at(place[known])
        newer = np.ones(len(new.ids), bool)
        same = (new.costs[known] == old.costs) & (new.tokens[known] == old.tokens)
        newer[known] = (new.ends[known] > old.ends) | ((new.ends[known] == old.ends) & ~same)
        out, into = old.at(newer[known]), new.at(newer)
        changes = pd.DataFrame(
            {
                name: np.concatenate([minus, plus])
                for name, minus, plus in zip(ENDS, out._columns(), into._columns(), strict=True)
            }
        ).drop(columns="id")
        changes["sign"] = np.repeat(np.array([-1, 1], np.int32), [len(out.ids), len(into.ids)])
        kept = np.ones(len(self.ids), bool)
        kept[place[known][newer[known]]] = False
        both = [np.concatenate(pair) for pair in zip(self.at(kept)._columns(), into._columns(), strict=True)]
        return Ends(*both).at(np.argsort(both[0], kind="stable")), changes


def tick_table(spark: SparkSession, progress: str, output: str, width_seconds: int) -> DayTable:
    return DayTable(spark, f"{output}/{TICKS}-{width_seconds}", MEASURES, progress)


def stream_ticks(
    sessions: DataFrame, progress: str, output: str, width_seconds: int, lateness: Lateness = IN_TIME, after=None
) -> list:
    """Keep a table of spend, tokens and sessions per tick up to date with a ledger stream;
    ``after`` is told the batch and the days that it touched."""
    stream_arrivals(sessions, progress, output, lateness)
    spark = sessions.sparkSession
    table = tick_table(spark, progress, output, width_seconds)
    schema = T.StructType([*SESSION_SCHEMA, *(T.StructField(c, t) for c, t in (("batch_id", T.LongType()), (LATE, T.BooleanType())))])
    in_time = spark.readStream.schema(schema).parquet(f"{output}/{SESSIONS}").where(f"NOT {LATE}")

    def write(batch: DataFrame, batch_id: int) -> None:
        ended = batch.withColumn("ended_at", F.timestamp_micros("end_micros"))
        sign = F.col("sign")
        deltas = ended.groupBy(F.to_date("ended_at").alias("date"), tick_of("ended_at", width_seconds).alias("tick")).agg(
            F.sum(exact(F.col("cost_usd")) * sign).cast(USD).alias("spent"),
            F.sum(F.col("tokens") * sign).alias("tokens"),
            F.sum(sign).cast("bigint").alias("sessions"),
        )
        deltas = deltas.persist()
        try:
            days = add_deltas(table, deltas, ["tick"], batch_id)
            if after:
                after(batch_id, days)
        finally:
            deltas.unpersist()

    return run_available(changed_ends(in_time, lateness), "update", write, f"{progress}/ticks-{width_seconds}")


def stored_ticks(table: DayTable, days=None) -> DataFrame:
    """date, tick, spent, tokens of ticks in which sessions ended."""
    return table.rows(days).where("sessions <> 0").drop("sessions")


def stream_daily_spend(
    sessions: DataFrame, progress: str, output: str, lateness: Lateness = IN_TIME
) -> DataFrame:
    """Daily spend of a ledger stream: date, cost_usd, tokens_total."""
    stream_ticks(sessions, progress, output, DAY_SECONDS, lateness)
    table = tick_table(sessions.sparkSession, progress, output, DAY_SECONDS)
    return stored_ticks(table).select(
        "date", F.col("spent").cast("double").alias("cost_usd"), F.col("tokens").alias("tokens_total")
    )


ALERT_KEYS = ("date", "tick")


def alerts_on(totals: DataFrame, days: DataFrame | None, width_seconds: int, thresholds: Thresholds) -> DataFrame:
    """Alerts from tick totals, on the given days or on all from the first to the last."""
    burned = burn_from(ticks_from(totals, width_seconds, days), width_seconds)
    priced = burned.withColumn("spend_usd", F.col("spend").cast("double")).drop("spend")
    return alerts_from(priced, thresholds)


def stream_alerts(
    sessions: DataFrame,
    progress: str,
    output: str,
    width_seconds: int = 3600,
    thresholds: Thresholds = DEFAULTS,
    lateness: Lateness = IN_TIME,
) -> DataFrame:
    """Budget state, burn rate and projection at each tick of a ledger stream.

    A batch renews the alerts of the days it touches and of the days after them, whose first
    tick follows the last one of the day before, 0 where nothing was spent; a reader of
    ``output`` sees them while the stream runs.
    """
    spark = sessions.sparkSession
    table = tick_table(spark, progress, output, width_seconds)

    def renew(batch_id: int, days: list) -> None:
        held = set(table.days())
        one = timedelta(days=1)
        stale = sorted({d for day in days for d in (day, day + one) if d in held})
        read = sorted({d for day in stale for d in (day - one, day)})
        ticks = stored_ticks(table, read)
        grid = spark.createDataFrame([(d,) for d in read], "date DATE")
        alerts = alerts_on(ticks, grid, width_seconds, thresholds)
        alert_table(spark, progress, output, width_seconds).replace(
            batch_id, stale, lambda _: alerts.where(F.col("date").isin(stale))
        )

    stream_ticks(sessions, progress, output, width_seconds, lateness, renew)
    return stored_alerts(spark, progress, output, width_seconds, thresholds)


def alert_table(spark: SparkSession, progress: str, output: str, width_seconds: int) -> DayTable:
    nothing = spark.createDataFrame([], T.StructType([*MEASURES[:3], T.StructField("date", T.DateType())]))
    fields = [f for f in alerts_on(nothing, None, width_seconds, DEFAULTS).schema if f.name != "date"]
    return DayTable(spark, f"{output}/{ALERTS}-{width_seconds}", fields, progress)


def stored_alerts(
    spark: SparkSession, progress: str, output: str, width_seconds: int = 3600, thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """The alerts of all days from the first to the last on which a session ended. Nothing
    burns in the first tick of all."""
    ticks = stored_ticks(tick_table(spark, progress, output, width_seconds))
    held = alert_table(spark, progress, output, width_seconds).rows()
    span = ticks.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo IS NOT NULL")
    days = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"), "lo")
    quiet = days.select("date").join(held.select("date").distinct(), "date", "left_anti")
    silent = alerts_on(ticks.where("false"), quiet, width_seconds, thresholds)
    first = (F.col("date") == F.col("lo")) & (F.col("tick") == 0)
    burn = F.when(~first, F.col("burn_usd_per_hour")).otherwise(0.0)
    whole = held.unionByName(silent).join(days, "date").withColumn("burn_usd_per_hour", burn).drop("lo")
    return whole.withColumn("projected_usd", projected())


DAILY = [T.StructField("spent", T.DecimalType(28, 10)), T.StructField("tokens_total", T.LongType())]


def daily_table(spark: SparkSession, progress: str, output: str) -> DayTable:
    return DayTable(spark, f"{output}/daily", DAILY, progress)


def stream_daily_upsert(daily: DataFrame, progress: str, output: str) -> DataFrame:
    """Add arriving daily rows (date, cost_usd, tokens_total) to a stored daily table, measure
    by measure and each row once, also if a batch dies on the way and is repeated."""
    spark = daily.sparkSession
    table = daily_table(spark, progress, output)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("date").agg(
            F.sum(exact(F.col("cost_usd"))).cast(USD).alias("spent"), F.sum("tokens_total").alias("tokens_total")
        )
        new = new.persist()
        try:
            add_deltas(table, new, [], batch_id)
        finally:
            new.unpersist()

    run_available(daily, "append", write, progress)
    return table.rows().select("date", F.col("spent").cast("double").alias("cost_usd"), "tokens_total")
