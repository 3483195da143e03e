"""Day tables that a stream keeps up to date, at a cost that does not grow with the stream.

Every day has two slots. A batch reads the current slot of the days it touches, works out
their new rows and writes these to the other slot. A small table of the current slots, one
row per day, is written last and makes them current: until then readers see the state
before. A batch that died on the way is repeated and overwrites what it left; one that was
applied is skipped. There is no pile of batch folders to compact: a day holds two versions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "date DATE, slot INT"
BLANK = T.StructField("_blank", T.BooleanType())
#: Days that one table may have; a mistaken date fails instead of making more.
MOST_DAYS = 36_600


@dataclass
class Alternating:
    """A small table that every batch of one stream replaces. Batches take turns in two
    folders, so the state before a batch stays readable until the batch has written its own.
    ``stream`` names the stream, by its progress folder: batches of another one, whose numbers
    mean nothing here, are refused."""

    spark: SparkSession
    path: str
    columns: str
    stream: str

    def rows(self, before: int | None = None) -> tuple[int, list]:
        """The newest batch, -1 for none, and its rows; of batches before the given one."""
        held = []
        for turn in (0, 1):
            try:
                stored = self.spark.read.schema(self._schema()).parquet(f"{self.path}/turn={turn}")
                held += stored.collect()  # one row per day at most
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
        others = {r.stream for r in held} - {self.stream}
        if others:
            raise ValueError(f"{self.path} belongs to a stream with another progress folder: {others}")
        held = [r for r in held if before is None or r.batch_id < before]
        newest = max((r.batch_id for r in held), default=-1)
        return newest, [r for r in held if r.batch_id == newest]

    def write(self, batch_id: int, rows: Sequence[tuple]) -> None:
        table = self.spark.createDataFrame([(*row, batch_id, self.stream) for row in rows], self._schema())
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/turn={batch_id % 2}")

    def _schema(self) -> str:
        return f"{self.columns}, batch_id BIGINT, stream STRING"


@dataclass
class DayTable:
    """Rows by ``date``, stored under ``path`` by one stream; ``fields`` are the other columns."""

    spark: SparkSession
    path: str
    fields: list[T.StructField]
    stream: str

    @property
    def _current(self) -> Alternating:
        return Alternating(self.spark, f"{self.path}/current", MANIFEST, self.stream)

    def _read(self, slots: dict[date, int]) -> DataFrame:
        """Rows of the given slots; no other folder is listed or read."""
        keys = [T.StructField("date", T.DateType()), T.StructField("slot", T.IntegerType())]
        schema = T.StructType([*self.fields, BLANK, *keys])
        if slots:
            folders = [f"{self.path}/days/date={day}/slot={slot}" for day, slot in sorted(slots.items())]
            stored = self.spark.read.schema(schema).option("basePath", f"{self.path}/days").parquet(*folders)
        else:
            stored = self.spark.createDataFrame([], schema)
        return stored.where(f"NOT {BLANK.name}").select(*(f.name for f in self.fields), "date")

    def _slots(self) -> tuple[int, dict[date, int]]:
        batch, rows = self._current.rows()
        return batch, {r.date: r.slot for r in rows if r.date is not None}

    def rows(self, days: Sequence[date] | None = None) -> DataFrame:
        """The current rows, of all days or of the given ones."""
        slots = self._slots()[1]
        return self._read(slots if days is None else {day: slots[day] for day in days if day in slots})

    def days(self) -> list[date]:
        return sorted(self._slots()[1])

    def replace(self, batch_id: int, days: Sequence[date], renew: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of days by ``renew`` of their current ones, once per batch."""
        newest, slots = self._slots()
        if newest >= batch_id:
            return
        if len(slots.keys() | set(days)) > MOST_DAYS:
            raise ValueError(f"more than {MOST_DAYS} days, up to {max(days)}")
        touched = {day: 1 - slots.get(day, 1) for day in days}
        if touched:
            new = renew(self._read({day: slots[day] for day in touched if day in slots}))
            self._store(new, touched)
        self._commit(batch_id, {**slots, **touched})

    def _store(self, rows: DataFrame, slots: dict[date, int]) -> None:
        numbers = self.spark.createDataFrame(list(slots.items()), "date DATE, slot INT")
        names = [f.name for f in self.fields]
        # A slot that got no file would keep what it held two versions ago.
        blank = numbers.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields), "date", F.lit(True).alias(BLANK.name))
        both = rows.select(*names, "date", F.lit(False).alias(BLANK.name)).unionAll(blank)
        (
            both.join(F.broadcast(numbers), "date")  # one row per touched day
            .repartition("date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "slot")
            .parquet(f"{self.path}/days")
        )

    def _commit(self, batch_id: int, slots: dict[date, int]) -> None:
        self._current.write(batch_id, [*slots.items(), (None, None)])


def touched_days(deltas: DataFrame) -> list[date]:
    """The days of a batch's rows, one row each."""
    return [r.date for r in deltas.where("date IS NOT NULL").select("date").distinct().collect()]


def add_deltas(table: DayTable, deltas: DataFrame, keys: Sequence[str], batch_id: int) -> list[date]:
    """Add signed measures to the rows of their day and keys; returns the days. Rows without
    a date are left out."""
    days = touched_days(deltas)
    measures = [f for f in table.fields if f.name not in keys]

    def summed(old: DataFrame) -> DataFrame:
        columns = ["date", *keys, *(f.name for f in measures)]
        both = old.select(*columns).unionAll(deltas.where("date IS NOT NULL").select(*columns))
        return both.groupBy("date", *keys).agg(*(F.sum(f.name).cast(f.dataType).alias(f.name) for f in measures))

    table.replace(batch_id, days, summed)
    return days
