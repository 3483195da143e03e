import datetime as dt

from pyspark.sql import functions as F

from promptledger.operators import budget, ledger, scrubbing
from promptledger.plans.storage import fresh_path
from promptledger.settings import Thresholds
from promptledger.sources.tables import SESSION_SCHEMA
from promptledger.streaming import gate
from promptledger.streaming import ledger as live

DAY = dt.datetime(2024, 3, 1)


def row(number, hours, cost=1.0):
    end = None if hours is None else DAY + dt.timedelta(hours=hours)
    return (number, f"u{number}", DAY, end, "gpt-4o", "t", 10, 5, 1, cost, 0, "")


def stream_of(spark, *batches):
    """A file stream that delivers each batch in its own micro-batch, in order."""
    path = fresh_path(spark, "arriving")
    for batch in batches:
        spark.createDataFrame(batch, SESSION_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return (
        spark.readStream.schema(SESSION_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    )


def all_rows(*batches):
    return [r for batch in batches for r in batch]


def folders(spark):
    return fresh_path(spark, "progress"), fresh_path(spark, "output")


def test_daily_spend_counts_late_and_corrected_ends(spark):
    batches = (
        [row(1, 1), row(2, 2), row(3, None)],
        [row(4, 26)],
        [row(5, 5, 0.5), row(1, 2, 5.0)],
        [row(6, 150)],
        [row(8, 3, 100.0), row(4, 25, 9.0)],
    )
    rows = live.stream_daily_spend(stream_of(spark, *batches), *folders(spark)).collect()
    # Session 1 ended again at 5.0; the older end of session 4 that arrives last changes nothing.
    assert {str(r.date): (r.cost_usd, r.tokens_total) for r in rows} == {
        "2024-03-01": (5.0 + 1.0 + 0.5 + 100.0, 64),
        "2024-03-02": (1.0, 16),
        "2024-03-07": (1.0, 16),
    }


def test_alerts_equal_the_batch_operator(spark):
    batches = ([row(n, n / 3) for n in range(1, 30)], [row(n, n / 3) for n in range(30, 80)])
    limits = Thresholds(daily_limit=20.0)
    streamed = live.stream_alerts(stream_of(spark, *batches), *folders(spark), 3600, limits)
    whole = spark.createDataFrame(all_rows(*batches), SESSION_SCHEMA)
    expected = budget.alerts_from(budget.burn_rate(whole, 3600), limits)
    columns = expected.columns
    assert sorted(streamed.select(columns).collect()) == sorted(expected.collect(), key=lambda r: r[:2])


def test_streams_go_on_where_they_stopped(spark):
    source, places = fresh_path(spark, "arriving"), folders(spark)

    def run(*rows):
        spark.createDataFrame(rows, SESSION_SCHEMA).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(SESSION_SCHEMA).parquet(source)
        return {r.id: r.cost_usd for r in live.stream_unique_sessions(arriving, *places).collect()}

    assert run(row(1, 1, 1.0), row(2, 2)) == {1: 1.0, 2: 1.0}
    assert run(row(1, 1.5, 5.0), row(3, 3)) == {1: 5.0, 2: 1.0, 3: 1.0}
    assert run(row(1, 1, 1.0)) == {1: 5.0, 2: 1.0, 3: 1.0}


def test_streams_over_nothing(spark):
    source = fresh_path(spark, "nothing")
    spark.createDataFrame([], SESSION_SCHEMA).write.parquet(source)
    arriving = spark.readStream.schema(SESSION_SCHEMA).parquet(source)
    for run in (live.stream_unique_sessions, live.stream_daily_spend, live.stream_alerts):
        assert run(arriving, *folders(spark)).count() == 0
    payloads = spark.readStream.schema("payload_id BIGINT, text STRING").parquet(source)
    assert gate.stream_scrub(payloads, *folders(spark)).count() == 0


def test_repeated_sessions_count_once(spark):
    batches = ([row(1, 1), row(2, 2), row(1, 1)], [row(2, 2), row(3, 3)])
    unique = live.stream_unique_sessions(stream_of(spark, *batches), *folders(spark))
    assert sorted(r.id for r in unique.collect()) == [1, 2, 3]
    assert ledger.daily_spend(unique).first().cost_usd == 3.0


def test_a_replayed_batch_changes_nothing(spark):
    from promptledger.streaming.sinks import batch_writer

    path = fresh_path(spark, "replay")
    write = batch_writer(path)
    batch = spark.range(5).withColumn("v", F.lit(1))
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(path).count() == 5


def test_scrub_gate_equals_the_batch_operator(spark, texts):
    table = texts("fine", "mail a@b.co", "SSN 123-45-6789", "ok " * 50)
    path = fresh_path(spark, "payloads")
    table.where("payload_id < 2").write.mode("append").parquet(path)
    table.where("payload_id >= 2").write.mode("append").parquet(path)
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.payload_id: (r.text, r.findings, r.blocked) for r in gate.stream_scrub(arriving, *folders(spark)).collect()}
    expected = {
        r.payload_id: (r.clean, len(r.findings), r.has_secrets)
        for r in scrubbing.scrubbed(table).collect()
    }
    assert got == expected
