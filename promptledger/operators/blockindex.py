"""A stored index of a corpus' blocks, to which payloads are added without redoing the corpus.

The index is a table of one row per distinct window, bucketed by its 128-bit key. Added
payloads are reduced to such rows, which are shuffled once and meet the buckets where they
lie; the index itself never moves. An addition writes the merged index to the folder that the
last one left free, and then a row that makes it current: until then readers see the state
before. An addition that died is repeated under its name, one that was applied is skipped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.operators.redundancy import block_totals, hashed_blocks
from promptledger.plans.storage import stored
from promptledger.settings import DEFAULTS, Thresholds

KEY = ("key", "key2")
ROW = (
    "key BIGINT, key2 BIGINT, first_payload BIGINT, first_line INT, payloads BIGINT, "
    "occurrences BIGINT"
)
LOG = "version INT, batch STRING, buckets INT, window_lines INT, window_min_words INT"


@dataclass
class BlockIndex:
    """The index stored under ``path``, by one writer at a time.

    ``buckets`` counts for the first addition; without it the session's shuffle partitions
    do, which spares added rows a second shuffle. A payload belongs to one addition.
    """

    spark: SparkSession
    path: str
    thresholds: Thresholds = DEFAULTS
    buckets: int | None = None

    def add(self, payloads: DataFrame, batch: str) -> bool:
        """Add payloads under the name of their batch; whether they were not there yet."""
        log = self._log()
        if any(r.batch == batch for r in log):
            return False
        version = len(log)
        buckets = log[-1].buckets if log else self.buckets or self._shuffle_partitions()
        new = self.merged(payloads) if log else self._totals(payloads)
        name = self._name()
        (
            new.write.mode("overwrite")
            .bucketBy(buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self._slot(version))
            .saveAsTable(name)
        )
        self.spark.sql(f"DROP TABLE {name}")  # of the catalog; the folder stays
        self._commit(version, batch, buckets)
        return True

    def _commit(self, version: int, batch: str, buckets: int) -> None:
        row = self.spark.createDataFrame([(version, batch, buckets, *self._limits())], LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def merged(self, payloads: DataFrame) -> DataFrame:
        """The rows of the index with those of payloads added."""
        old, new = self.blocks().alias("old"), self._totals(payloads).alias("new")
        same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in KEY]
        earlier = F.expr("old.first_payload IS NULL OR new.first_payload < old.first_payload")
        total = {c: F.expr(f"coalesce(old.{c}, 0) + coalesce(new.{c}, 0)") for c in ("payloads", "occurrences")}
        return old.join(new, same, "full_outer").select(
            *(F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in KEY),
            *(
                F.when(earlier, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
                for c in ("first_payload", "first_line")
            ),
            *(sums.alias(c) for c, sums in total.items()),
        )

    def blocks(self) -> DataFrame:
        """All rows of the index, read by bucket."""
        log = self._log()
        if not log:
            return self.spark.createDataFrame([], ROW)
        name = self._name()
        self.spark.sql(
            f"CREATE TABLE {name} ({ROW}) USING parquet OPTIONS (path '{self._slot(log[-1].version)}') "
            f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {log[-1].buckets} BUCKETS"
        )
        rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return rows

    def shared(self) -> DataFrame:
        """Windows that occur more than once, as ``shared_blocks`` finds them in all payloads."""
        return self.blocks().where("occurrences > 1")

    def known_in(self, payloads: DataFrame) -> DataFrame:
        """Every window of other payloads that the index holds, with its first holder there.

        Windows of the payloads are combined before they meet the index, so the hits are few
        rows; the join back to all their holders is between two stored tables, whose hot keys
        adaptive execution splits.
        """
        members = stored(self._hashed(payloads), "new-blocks")
        keys = members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("holders"))
        found = keys.join(self.blocks(), list(KEY)).select(
            *KEY, "first_payload", F.col("first_line").alias("source_line"), "payloads"
        )
        joined = members.join(stored(found, "known-blocks"), list(KEY))
        return joined.select(
            "payload_id", "first_line", "copies", "first_payload", "source_line", "payloads"
        )

    def _hashed(self, payloads: DataFrame) -> DataFrame:
        return hashed_blocks(payloads, self.thresholds)

    def _totals(self, payloads: DataFrame) -> DataFrame:
        return block_totals(self._hashed(payloads))

    def _log(self) -> list:
        """One row per addition, in order."""
        try:
            log = self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("version").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if any((r.window_lines, r.window_min_words) != self._limits() for r in log):
            raise ValueError(f"{self.path} holds windows of other thresholds than {self._limits()}")
        return log

    def _limits(self) -> tuple[int, int]:
        return self.thresholds.window_lines, self.thresholds.window_min_words

    def _slot(self, version: int) -> str:
        return f"{self.path}/slot={version % 2}"

    def _name(self) -> str:
        return f"block_index_{uuid.uuid4().hex}"

    def _shuffle_partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))
