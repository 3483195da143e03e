"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Documents are dealt into partitions by a hash of all they hold; their counts are known.
2. The matrix says how many documents of each partition go to each shard. Its lines are
   drawn one after the other from the multivariate hypergeometric law of what the shards
   still lack, which is the law of a uniform permutation of all documents.
3. Every partition is permuted by itself; runs of the permutation go to the shards as the
   line says, and are exchanged.
4. Every shard is permuted again: documents are dealt into the shard's chunks by hash, each
   chunk is sorted by hash, and its slots follow those of the chunks before.

Shard sizes differ by at most one, whatever texts repeat; all copies of a text are dealt
one by one. The draws depend on the seed alone, so a lost executor's tasks repeat them.
The driver holds one number per partition and shard.

Result: all rows and columns, plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each
shard). Columns of these names are replaced. Nulls are values like any other. Rows equal in
all columns are interchangeable. With fewer rows than shards some shards are empty; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger.llm.tables import stored

SHARDS = 8
SEED = 20_240_229


def hypergeometric(good: int, bad: int, draws: int, random: Random) -> int:
    """How many of ``draws`` without return from good and bad ones are good: inversion
    from the mode outwards, exact up to rounding of the probabilities at any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low

    def choices(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    chance = math.exp(choices(good, mode) + choices(bad, draws - mode) - choices(good + bad, draws))
    left = random.random()
    down = up = mode
    chance_down = chance_up = chance
    left -= chance
    while left > 0 and (down > low or up < high):
        if up < high:
            chance_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= chance_up
            if left <= 0:
                return up
        if down > low:
            chance_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= chance_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], lacking: list[int], seed: int) -> list[list[int]]:
    """How many of each partition's documents go to each shard."""
    random = Random(seed)
    lacking = list(lacking)
    matrix = []
    for count in counts:
        line, rest, draws = [], sum(lacking), count
        for lack in lacking:
            rest -= lack
            line.append(hypergeometric(lack, rest, draws, random))
            draws -= line[-1]
        lacking = [a - b for a, b in zip(lacking, line, strict=True)]
        matrix.append(line)
    return matrix


def exact_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes that differ by at most one."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Deal all rows into shards uniformly at random."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Kept in one struct, columns of any name do not clash with those added here.
    keyed = docs.select(F.struct(*columns).alias("_row"), F.xxhash64(*columns).alias("_key")).withColumn(
        "_part", F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(parts)).cast("int")
    )
    known = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}
    counts = [known.get(p, 0) for p in range(parts)]
    matrix = communication_matrix(counts, exact_sizes(sum(counts), shards), seed)
    lines = spark.createDataFrame(
        [(p, [sum(line[: k + 1]) for k in range(shards)]) for p, line in enumerate(matrix)],
        "_part INT, _upto ARRAY<BIGINT>",
    )
    permuted = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64("_key", F.lit(seed + 1)), "_key"))
    # One line per partition: a few thousand at most, as many as there are tasks.
    dealt = (
        keyed.withColumn("_rank", permuted)
        .join(F.broadcast(lines), "_part")
        .withColumn("shard", F.size(F.filter("_upto", lambda end: end < F.col("_rank"))))
    )
    chunks = max(1, parts // shards)
    # The part and rank tell equal rows apart.
    order = F.xxhash64("_key", "_part", "_rank", F.lit(seed + 2))
    chunk = F.pmod(F.xxhash64("_part", "_rank", F.lit(seed + 3)), F.lit(chunks)).cast("int")
    dealt = dealt.withColumn("_chunk", chunk).drop("_upto")
    sizes = stored(
        dealt.groupBy("shard", "_chunk").count(),
        "shard-chunks",
    )
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    again = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(order, "_part", "_rank"))
    # Chunks are as many as partitions; their first slots are broadcast.
    return (
        dealt.withColumn("_again", again)
        .join(F.broadcast(first), ["shard", "_chunk"])
        .withColumn("slot", F.col("_first") + F.col("_again") - 1)
        .select("_row.*", "shard", "slot")
    )
