"""A training-data pipeline over ``documents``: each stage is one of the operators.

All stages but the last return the columns of ``documents`` and treat odd rows like this:

- a null or empty text is scored like any other, is nobody's near duplicate, holds no passage
  and no private data, and is packed as its end id alone;
- a null id is never labelled; such rows are told apart by their texts, as rows that share an
  id are; of rows equal in id and text one stays, unless they have no words;
- other columns travel unread, whatever their names; only ``n_values`` holds the number of
  values replaced afterwards, if ``documents`` has such a column;
- without labels all documents are accepted, without test items none is dropped, and an empty
  ``documents`` gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm import decontaminate, packing, pseudonyms, quality, signature_join
from promptledger.llm.queries import pseudonym_key, table, vocabulary
from promptledger.plans.storage import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to ``labels``, accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return signature_join.one_per_group(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``, nor an edited copy of one."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; ``n_chars`` follows the text."""
    changed = pseudonyms.pseudonymised(docs, pseudonym_key(spark))
    if "n_chars" in docs.columns:
        new = F.when(F.col("n_values") > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", new.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("near duplicates", one_per_group),
    ("benchmark decontamination", without_leaks),
    ("private data", without_private_data),
    ("packing", packed),
]

#: Trees, alignment, keyed permutations and packing have no SQL form; tests hold the rows
#: against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
