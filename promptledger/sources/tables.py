"""Payload and ledger readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger import functions as fn

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_uuid", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("tokens_cached", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("warning_count", T.LongType()),
        T.StructField("notes", T.StringType()),
    ]
)
END_DATE = "end_date"
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CSV_COLUMNS = (
    "id",
    "model",
    "tag",
    "started_at",
    "tokens_in",
    "tokens_out",
    "tokens_cached",
    "cost_usd",
    "cache_hit_ratio",
    "cache_savings_usd",
)


def load_payloads(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_column: str = "payload_id",
    text_column: str = "text",
    model_column: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Payloads as ``(payload_id, text)``, with ``model`` where a column for it is named.

    ``text`` takes every file as one payload, whose id is a 64-bit hash of its path;
    ``parquet``, ``orc`` and ``json`` take one payload per record. A file whose records are
    one row group is read by one task; ``partitions`` deals its payloads out to so many,
    which shuffles them. Files of many row groups need no dealing.
    """
    if fmt == "text":
        payloads = _whole_files(spark.read.text(path, wholetext=True))
    elif fmt == "json":
        source = spark.read.schema(_payload_schema(id_column, text_column, model_column)).json(path)
        payloads = _as_payloads(source, id_column, text_column, model_column)
    else:
        payloads = _as_payloads(spark.read.format(fmt).load(path), id_column, text_column, model_column)
    return payloads if partitions is None else payloads.repartition(partitions)


def _whole_files(files: DataFrame) -> DataFrame:
    return files.select(F.xxhash64("_metadata.file_path").alias("payload_id"), F.col("value").alias("text"))


def _payload_schema(id_column: str, text_column: str, model_column: str | None) -> str:
    model = f", `{model_column}` STRING" if model_column else ""
    return f"`{id_column}` BIGINT, `{text_column}` STRING{model}"


def _as_payloads(
    source: DataFrame, id_column: str, text_column: str, model_column: str | None
) -> DataFrame:
    named = {"payload_id": id_column, "text": text_column}
    if model_column:
        named["model"] = model_column
    return source.select(*(F.col(column).alias(name) for name, column in named.items()))


def stream_payloads(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_column: str = "payload_id",
    text_column: str = "text",
    model_column: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Payloads as they arrive in a folder, the same as ``load_payloads`` reads them. A text
    file counts when it is there, as a whole, and must not be appended to."""
    if fmt == "text":
        payloads = _whole_files(spark.readStream.text(path, wholetext=True))
    else:
        schema = _payload_schema(id_column, text_column, model_column)
        arriving = spark.readStream.schema(schema).format(fmt).load(path)
        payloads = _as_payloads(arriving, id_column, text_column, model_column)
    return payloads if partitions is None else payloads.repartition(partitions)


def stream_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Ledger sessions as they arrive in a folder."""
    return spark.readStream.schema(SESSION_SCHEMA).format(fmt).load(path)


def load_pairs(left: DataFrame, right: DataFrame, key: str = "payload_id") -> DataFrame:
    """Join two payload tables on their key as ``(pair_id, original, optimized)``."""
    first = left.select(F.col(key).alias("pair_id"), F.col("text").alias("original"))
    second = right.select(F.col(key).alias("pair_id"), F.col("text").alias("optimized"))
    return first.join(second, "pair_id")


def load_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored ledger; columns that older files lack are read as null."""
    return spark.read.schema(SESSION_SCHEMA).format(fmt).load(path)


#: Columns that sessions are looked up by: files carry Bloom filters of them, so a lookup
#: reads the row groups that may hold the key, whatever range of keys each spans.
LOOKUP_COLUMNS = ("id", "session_uuid")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Append to a stored ledger, in folders by the day sessions ended.

    Columns of other types would make the whole ledger unreadable, so they are refused.
    """
    kinds = dict(sessions.dtypes)
    wrong = [f.name for f in SESSION_SCHEMA if kinds.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"columns with another type than the ledger's: {wrong}")
    dated = sessions.withColumn(END_DATE, F.to_date("ended_at"))
    writer = dated.write.mode("append").partitionBy(END_DATE)
    for column in LOOKUP_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def sessions_ended_on(spark: SparkSession, path: str, days: Sequence[str]) -> DataFrame:
    """Sessions of a stored ledger that ended on the given days; other folders stay unread."""
    stored = spark.read.schema(T.StructType([*SESSION_SCHEMA, T.StructField(END_DATE, T.DateType())])).parquet(path)
    wanted = F.col(END_DATE).isin(*(F.lit(d).cast("date") for d in days))
    return stored.where(wanted).drop(END_DATE)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write cleaned payloads, in folders by the values of the given columns; plain text files
    hold the text alone."""
    columns = ["text"] if fmt == "text" else ["payload_id", "text"]
    columns += [c for c in partition_by if c not in columns]
    df.select(*columns).write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write a report as JSON lines, absent values left out, times to the microsecond."""
    df.write.mode("overwrite").json(path, timestampFormat=JSON_TIME)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, timestampFormat=JSON_TIME)


def csv_rows(report: DataFrame) -> DataFrame:
    """The ten report columns as text: 6 decimals for money, 4 for the ratio."""
    stamp = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    as_text = {
        "started_at": stamp,
        "cost_usd": fn.fixed("cost_usd", 6),
        "cache_hit_ratio": fn.fixed("cache_hit_ratio", 4),
        "cache_savings_usd": fn.fixed("cache_savings_usd", 6),
    }
    return report.select(
        *(as_text.get(c, F.col(c).cast("string")).alias(c) for c in CSV_COLUMNS)
    )


def write_csv(report: DataFrame, path: str) -> None:
    csv_rows(report).write.mode("overwrite").csv(path, header=True)


def read_csv_report(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} STRING" for c in CSV_COLUMNS)
    return spark.read.schema(schema).csv(path, header=True)


def audit_log(payloads: DataFrame, logged_at=None) -> DataFrame:
    """One SHA-256 per payload; the log never holds the text itself."""
    when = F.current_timestamp() if logged_at is None else logged_at
    return payloads.select(
        when.alias("logged_at"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    )


def append_audit_log(payloads: DataFrame, path: str) -> None:
    """Append ``<RFC 3339 time> sha256=<hex>`` lines."""
    stamp = F.date_format("logged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    audit_log(payloads).select(
        F.concat(stamp, F.lit(" sha256="), F.col("sha256")).alias("value")
    ).write.mode("append").text(path)
