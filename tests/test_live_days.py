"""Day tables of streams: late, corrected and expired ends, killed and repeated batches."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.plans.storage import fresh_path
from promptledger.sources.tables import SESSION_SCHEMA
from promptledger.streaming import days
from promptledger.streaming import ledger as live

DAY = dt.datetime(2024, 3, 1)
SHORT = live.Lateness(dt.timedelta(days=1), dt.timedelta(days=2))


@pytest.fixture(autouse=True)
def few_tasks(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def row(number, hours, cost=1.0):
    return (number, f"u{number}", DAY, DAY + dt.timedelta(hours=hours), "gpt-4o", "t", 10, 5, 1, cost, 0, "")


class Source:
    """Sessions that arrive in a folder, and runs over what has arrived."""

    def __init__(self, spark):
        self.spark = spark
        self.path = fresh_path(spark, "arriving")
        self.progress, self.output = fresh_path(spark, "progress"), fresh_path(spark, "output")

    def arrive(self, *rows):
        self.spark.createDataFrame(rows, SESSION_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return self.spark.readStream.schema(SESSION_SCHEMA).parquet(self.path), self.progress, self.output


def spent(rows):
    return {str(r.date)[5:]: (r.cost_usd, r.tokens_total) for r in rows.collect()}


def test_late_corrected_and_expired_ends(spark):
    source = Source(spark)

    def run(*rows):
        reports = live.stream_ticks(*source.arrive(*rows), live.DAY_SECONDS, SHORT)
        table = live.tick_table(spark, source.progress, source.output, live.DAY_SECONDS)
        kept = [r.stateOperators[0].numRowsTotal for r in reports if r.stateOperators]
        return {str(r.date)[5:]: float(r.spent) for r in live.stored_ticks(table).collect()}, kept[-1]

    assert run(row(1, 1), row(2, 2), row(1, 1))[0] == {"03-01": 2.0}
    assert run(row(1, 30, 5.0), row(1, 1))[0] == {"03-01": 1.0, "03-02": 5.0}  # corrected, then repeated
    assert run(*(row(n, 240 + n) for n in range(10, 20)))[0]["03-11"] == 10.0
    result, kept = run(row(3, 2, 100.0), row(20, 261))  # too late by more than a day
    assert result == {"03-01": 1.0, "03-02": 5.0, "03-11": 11.0}
    # Sessions 1 and 2 can no longer be corrected: their states are gone.
    assert kept == spark.range(10, 21).select(F.pmod(F.xxhash64("id"), F.lit(live.BUCKETS))).distinct().count()
    assert [r.id for r in live.late_sessions(spark, source.output).collect()] == [3]
    assert live.late_count(spark, source.progress, source.output)[1] == 1
    assert sorted(r.id for r in live.stored_sessions(spark, source.output).collect()) == [1, 2, *range(10, 21)]


def files(path):
    return {str(f): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_batch_writes_only_the_days_it_touches(spark):
    source = Source(spark)
    live.stream_alerts(*source.arrive(*(row(n, 24 * n) for n in range(6))), 3600)
    before = files(source.output)
    live.stream_alerts(*source.arrive(row(100, 24 * 2 + 5)), 3600)
    after = files(source.output)
    changed = {f for f in after if before.get(f) != after[f]}
    touched = {part for f in changed for part in Path(f).parts if part.startswith("date=")}
    assert touched == {"date=2024-03-03", "date=2024-03-04"}  # the alerts of the day after follow it
    ticks = {part for f in changed if "/ticks-3600/" in f for part in Path(f).parts if part.startswith("date=")}
    assert ticks == {"date=2024-03-03"}
    # No day holds more than two versions, however many batches touched it.
    for hour in (6, 7, 8):
        live.stream_alerts(*source.arrive(row(100 + hour, 24 * 2 + hour)), 3600)
    slots = [p for p in Path(source.output, "ticks-3600", "days", "date=2024-03-03").iterdir() if p.is_dir()]
    assert len(slots) == 2 and len(files(source.output)) <= len(after) + 3 * 3


DAILY = "date DATE, cost_usd DOUBLE, tokens_total BIGINT"


def test_upsert_killed_before_it_was_made_current(spark, monkeypatch):
    path, progress, output = (fresh_path(spark, n) for n in ("daily", "progress", "output"))
    first, second = DAY.date(), DAY.date() + dt.timedelta(days=1)

    def run(*rows):
        if rows:
            spark.createDataFrame(rows, DAILY).coalesce(1).write.mode("append").parquet(path)
        return spent(live.stream_daily_upsert(spark.readStream.schema(DAILY).parquet(path), progress, output))

    assert run((first, 1.5, 10), (first, 0.5, 1), (None, 9.0, 9)) == {"03-01": (2.0, 11)}
    commit = days.DayTable._commit
    killed = []

    def die(self, batch_id, slots):
        killed.append(batch_id)
        raise RuntimeError("killed")

    monkeypatch.setattr(days.DayTable, "_commit", die)
    with pytest.raises(Exception, match="killed"):
        run((first, 4.0, 4), (second, 1.0, 1))
    table = live.daily_table(spark, progress, output)
    assert killed == [1] and [float(r.spent) for r in table.rows().collect()] == [2.0]  # as before
    monkeypatch.setattr(days.DayTable, "_commit", commit)
    assert run() == {"03-01": (6.0, 15), "03-02": (1.0, 1)}

    # Killed after it was made current, before the stream knew: the repeat is skipped.
    add = days.add_deltas

    def late_death(*args):
        add(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(live, "add_deltas", late_death)
    with pytest.raises(Exception, match="killed"):
        run((second, 2.0, 2))
    monkeypatch.setattr(live, "add_deltas", add)
    assert run() == {"03-01": (6.0, 15), "03-02": (3.0, 3)}


def test_slots_replays_and_other_streams(spark):
    fields = [T.StructField("n", T.LongType())]
    table = days.DayTable(spark, fresh_path(spark, "days"), fields, "a")
    one, two = DAY.date(), DAY.date() + dt.timedelta(days=1)

    def deltas(*rows):
        return spark.createDataFrame(rows, "n BIGINT, date DATE")

    def held(of=None):
        return sorted((r.n, r.date) for r in table.rows(of).collect())

    assert held() == []
    days.add_deltas(table, deltas((1, one), (2, one), (5, two)), [], 0)
    days.add_deltas(table, deltas((1, one), (2, one), (5, two)), [], 0)  # repeated
    assert held() == [(3, one), (5, two)]
    days.add_deltas(table, deltas((-3, one)), [], 1)
    days.add_deltas(table, deltas(), [], 2)
    assert held() == [(0, one), (5, two)] and held([two]) == [(5, two)]
    table.replace(3, [two], lambda old: old.where("false"))
    table.replace(4, [one], lambda old: old.withColumn("n", F.col("n") + 7))
    assert held() == [(7, one)] and table.days() == [one, two]
    with pytest.raises(ValueError, match="another progress folder"):
        days.add_deltas(days.DayTable(spark, table.path, fields, "b"), deltas((1, one)), [], 5)


def test_newest_ends_in_arrays():
    import numpy as np

    def ends(*rows):
        columns = zip(*sorted(rows), strict=True) if rows else [(), (), (), ()]
        return live.Ends(*(np.array(c, k) for c, k in zip(columns, (np.int64, np.int64, np.float64, np.int64), strict=True)))

    held, changes = live.Ends.none().renewed(ends((1, 10, 1.0, 1), (1, 20, 2.0, 2), (5, 7, 1.0, 1)))
    assert changes.values.tolist() == [[20, 2.0, 2, 1], [7, 1.0, 1, 1]]
    held, changes = held.renewed(ends((1, 20, 2.0, 2), (5, 9, 4.0, 4), (0, 1, 0.0, 0)))
    assert sorted(changes.values.tolist()) == [[1, 0.0, 0, 1], [7, 1.0, 1, -1], [9, 4.0, 4, 1]]
    assert held.ids.tolist() == [0, 1, 5] and held.ends.tolist() == [1, 20, 9]
    assert len(held.renewed(ends((5, 8, 9.0, 9)))[1]) == 0
    again = live.Ends.read(held.written())
    assert again.costs.tolist() == held.costs.tolist() and held.after(9).ids.tolist() == [1]
