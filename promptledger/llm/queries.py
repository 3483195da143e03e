"""Queries of the pipeline operators; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm import (
    anchorcodes,
    collocations,
    decontaminate,
    langid,
    packing,
    pseudonyms,
    quality,
    secretscan,
    sharding,
    signature_join,
    tokenfile,
    urlfilter,
    vectorgraph,
)
from promptledger.plans.storage import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Host, path and verdict of the listed canonical urls.
URL_RULES = (
    ("com", "/", urlfilter.ALLOW),
    ("example.com", "/en/", urlfilter.BLOCK),
    ("www.example.com", "/en/", urlfilter.ALLOW),
    ("net", "/es/", urlfilter.BLOCK),
    ("net", "/fr/", urlfilter.BLOCK),
)


def op3_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    return urlfilter.judged(table(spark, sf_dir, "pages"), rules)


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffled(table(spark, sf_dir, "documents"))
    held = F.coalesce("text", F.lit("")).cast("binary")
    return dealt.select(
        "doc_id",
        (F.octet_length(held) + 1).cast("bigint").alias("size"),
        F.crc32(held).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), pseudonym_key(spark))
    return found.select("doc_id", "text", "n_values")


def op6_backoff_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op7_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.similarity_components(table(spark, sf_dir, "documents"))


def pseudonym_key(spark: SparkSession) -> str:
    """The secret key of the pseudonyms; a fixed one where the session names none."""
    return spark.conf.get("spark.promptledger.pseudonymKey", "not a secret")


def vocabulary(name: str) -> str:
    """Where the public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_graph_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-ids")
    contents = tokenfile.write(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return tokenfile.read(spark, contents, folder)


def op11_convolved_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.finding_digest(secretscan.secrets(table(spark, sf_dir, "documents")))


def op12_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchorcodes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_boosted_quality,
        op2_benchmark_leaks,
        op3_bloom_url_filter,
        op4_hypergeometric_shards,
        op5_feistel_pseudonyms,
        op6_backoff_languages,
        op7_signature_tree_join,
        op8_swap_packing,
        op9_graph_near_duplicates,
        op10_pfor_token_files,
        op11_convolved_secrets,
        op12_stripe_collocations,
        op13_anchor_codes,
    )
}
