"""Running totals and carried values over ordered rows, without one task per group.

A window partitioned by a hot key runs in a single task. Here the rows are split by
range of the full order into even chunks, whatever the skew; each chunk is reduced to
a summary row, the few summaries are scanned in order, and every chunk then continues
from what its predecessors carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger.plans.storage import cut_lineage
from promptledger.sources.pricing import USD, exact

CHUNK = "_chunk"


def in_chunks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number even, contiguous ranges of the order; the numbers are stored.

    Range bounds come from a sample and would change if recomputed, so the numbered
    rows are checkpointed before they are used twice. ``order`` must be unique within
    ``by`` for ties to have one order.
    """
    keys = [*by, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def before_chunk(by: Sequence[str]):
    """Window over the chunk summaries that precede the current one in a group."""
    return (
        Window.partitionBy(*by)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def within_chunk(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by, CHUNK).orderBy(*order)


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Add inclusive running sums: ``sums`` maps a new column to the one it adds up.

    Doubles are added as decimals, so the result does not depend on chunk bounds.
    """
    kinds = dict(df.dtypes)

    def typed(column: str) -> Column:
        return exact(F.col(column)) if kinds[column] == "double" else F.col(column)

    def summed(column: Column, source: str) -> Column:
        return column.cast(USD) if kinds[source] == "double" else column

    chunked = in_chunks(df, by, order)
    summaries = chunked.groupBy(*by, CHUNK).agg(
        *(summed(F.sum(typed(src)), src).alias(f"_sum_{out}") for out, src in sums.items())
    )
    earlier = before_chunk(by)
    carried = summaries.select(
        *by,
        CHUNK,
        *(
            summed(F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)), src).alias(
                f"_base_{out}"
            )
            for out, src in sums.items()
        ),
    )
    upto = within_chunk(by, order).rowsBetween(Window.unboundedPreceding, 0)
    result = continue_from(chunked, carried, by).withColumns(
        {
            out: F.col(f"_base_{out}") + summed(F.sum(typed(src)).over(upto), src)
            for out, src in sums.items()
        }
    )
    return result.drop(CHUNK, *(f"_base_{out}" for out in sums))


def windows_ahead(
    df: DataFrame, by: Sequence[str], order: Sequence[str], item: Column, size: int
) -> DataFrame:
    """Add ``place`` in the group, from 1, and ``ahead``: the items of a row and of up to
    ``size - 1`` rows behind it.

    Windows cross chunk borders: each chunk receives the first items of those behind it. A
    chunk holds at least one row, so as many chunks as items are enough.
    """
    here = within_chunk(by, order)
    numbered = in_chunks(df.withColumn("_item", item), by, order).withColumn(
        "_place", F.row_number().over(here)
    )
    summaries = numbered.groupBy(*by, CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array_sort(
            F.collect_list(F.when(F.col("_place") < size, F.struct("_place", "_item")))
        ).alias("_head"),
    )
    behind = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(1, max(1, size - 1))
    received = F.flatten(F.collect_list("_head").over(behind))
    carried = summaries.select(
        *by,
        CHUNK,
        "_rows",
        F.coalesce(F.sum("_rows").over(before_chunk(by)), F.lit(0)).alias("_base"),
        F.slice(F.transform(received, lambda x: x["_item"]), 1, max(1, size - 1)).alias("_halo"),
    )
    # Only the last rows of a chunk keep what it received.
    last = F.col("_rows") - F.col("_place") < size - 1
    rows = continue_from(numbered, carried, by).withColumn("_halo", F.when(last, F.col("_halo")))
    own = F.collect_list("_item").over(here.rowsBetween(0, size - 1))
    ahead = F.when(last, F.slice(F.concat(own, "_halo"), 1, size)).otherwise(own)
    return rows.withColumns({"place": F.col("_base") + F.col("_place"), "ahead": ahead}).drop(
        CHUNK, "_item", "_place", "_rows", "_base", "_halo"
    )


def continue_from(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join what earlier chunks carry to the rows of each chunk; null groups match."""
    renamed = carried.withColumnsRenamed({c: f"_by_{c}" for c in (*by, CHUNK)})
    match = F.col(CHUNK) == F.col(f"_by_{CHUNK}")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(renamed, match).drop(*(f"_by_{c}" for c in (*by, CHUNK)))
