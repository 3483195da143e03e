"""URL filter: a blocked Bloom filter of listed canonical urls, then an exact hash join.

A list entry is a canonical url prefix: host and path, with a verdict. It fits its host, all
subdomains, and paths that start with its path; of the entries that fit, the longest decides
(then the longer host). A url none fits is allowed.

1. Each url gives candidate keys: endings of its host at label borders with beginnings of
   its path, of those lengths that the list has.
2. The Bloom filter has blocks of 512 bits, eight words. A key's hash picks the block and
   one bit per word, so a probe reads one block. Blocks are joined to the candidates by
   their number; few candidates of unlisted urls pass.
3. Candidates that passed are joined to the list by their key, which removes what passed
   wrongly, and the longest entry of each url wins.

Spark decides by measured size whether it broadcasts the blocks and the list. A host that
holds a third of all urls adds no skew: its equal candidates meet one list row, and rows are
reduced to distinct keys before.

Result: one row per page with host, path, rule (null if none) and verdict. A null url and one
without ``://`` have an empty host and path and are allowed. Repeated pages each keep their
row. An empty list allows all. Other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.llm.tables import stored

ALLOW, BLOCK = "allow", "block"
#: Words of 64 bits in a block, and list entries per block on average.
WORDS = 8
ENTRIES_PER_BLOCK = 32


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bit_words(key: Column) -> list[Column]:
    """Per word of the block the mask of the key's bit."""
    return [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(key, F.lit(k)), F.lit(64)).cast("int"))
        for k in range(WORDS)
    ]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (block, w0 .. w7) of the column ``key``."""
    return (
        keys.select(block_of(F.col("key"), blocks).alias("block"), *(w.alias(f"w{k}") for k, w in enumerate(bit_words(F.col("key")))))
        .groupBy("block")
        .agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))
    )


def key_of(host: Column, path: Column) -> Column:
    """Hosts hold no slash, so host and path can be told apart."""
    return F.concat(host, F.when(F.substring(path, 1, 1) == "/", F.lit("")).otherwise(F.lit("?")), path)


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge pages (page_id, url) by rules (host, path, verdict)."""
    listed = rules.select(
        lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).dropDuplicates(["rule_host", "rule_path"])
    listed = listed.withColumn("key", key_of(F.col("rule_host"), F.col("rule_path")))
    facts = listed.agg(
        F.count("*").alias("n"),
        F.collect_set(F.length("rule_host")).alias("hosts"),
        F.collect_set(F.length("rule_path")).alias("paths"),
    ).first()  # lengths of urls: a few hundred numbers at most
    blocks = max(1, -(-facts.n // ENTRIES_PER_BLOCK))
    urls = pages.select(
        F.col("page_id").cast("bigint"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    # Distinct hosts and beginnings of paths, however many pages share them.
    longest = max(facts.paths, default=0)
    urls = urls.withColumn("head", F.substring("path", 1, longest) if longest else F.lit(""))
    ends = F.filter(
        F.transform(
            F.array(*(F.lit(n) for n in sorted(facts.hosts))).cast("array<int>"),
            lambda n: F.when(F.length("host") == n, F.col("host")).when(
                F.substring(F.col("host"), F.length("host") - n, F.lit(1)) == ".",
                F.substring(F.col("host"), F.length("host") - n + 1, n),
            ),
        ),
        lambda h: h.isNotNull(),
    )
    starts = F.filter(
        F.transform(
            F.array(*(F.lit(n) for n in sorted(facts.paths))).cast("array<int>"),
            lambda n: F.when(F.length("head") >= n, F.substring(F.col("head"), F.lit(1), n)),
        ),
        lambda p: p.isNotNull(),
    )
    candidates = (
        urls.select("host", "head")
        .distinct()
        .select("host", "head", F.explode(ends).alias("rule_host"), starts.alias("starts"))
        .select("host", "head", "rule_host", F.explode("starts").alias("rule_path"))
        .withColumn("key", key_of(F.col("rule_host"), F.col("rule_path")))
        .withColumn("block", block_of(F.col("key"), blocks))
    )
    passes = F.lit(True)
    for k, word in enumerate(bit_words(F.col("key"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(word) != 0)
    possible = (
        candidates.join(bloom_blocks(listed, blocks), "block").where(passes).select("host", "head", "key")
    )
    fits = possible.join(listed, "key").withColumn("rule", F.concat("rule_host", "rule_path"))
    best = stored(
        fits.groupBy("host", "head").agg(
            F.max_by(
                F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"))
            ).alias("best")
        ),
        "url-rules",
    )
    return urls.join(best, ["host", "head"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"),
    )
