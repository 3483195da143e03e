"""Intermediate tables in the shared folder, and connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.plans.storage import fresh_path


#: Narrow rows that one task writes of a table whose size is known.
ROWS_PER_TASK = 500_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for so many narrow rows; their number grows with the rows."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the folder in ``spark.checkpoint.dir`` and read back.

    Later plans start from the files, so a lost executor repeats only what follows, and
    joins on them shuffle both sides, which lets adaptive execution split a hot key.
    ``rows``, at most how many narrow rows there are, keeps tasks and files few.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.coalesce(tasks_for(df, rows))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _are_stars(edges: DataFrame, rows: int) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("upper")).unionAll(
        edges.select("u", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper"))
    odd = ends.where("lower > 1 or (lower > 0 and upper > 0)").coalesce(tasks_for(edges, rows))
    return odd.count() == 0


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component), the component
    being its smallest node. Nodes without a link to another node are absent.

    Alternates large-star and small-star steps until every node hangs on a root. Smallest
    neighbours are aggregated before the shuffle and stored, so the joins to them can split
    a node that a third of all links share. Rounds grow with the logarithm of the longest
    chain; links that are stars already need none.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(
        links.where(F.col("a") != F.col("b")).select(high.alias("v"), low.alias("u")).distinct(),
        "links",
    )
    rows = 2 * edges.count()  # a round makes no more than one for each link and node
    while not _are_stars(edges, rows):
        both = edges.select("v", "u").unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(
            both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "smallest", rows
        )
        large = stored(
            both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(),
            "large-star",
            rows,
        )
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")), "smallest", rows)
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = stored(small.unionAll(least.select("v", F.col("m").alias("u"))).distinct(), "links", rows)
    roots = edges.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(roots)
