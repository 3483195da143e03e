"""Checks on physical plans: what shuffles, what is broadcast, what is pushed down."""

import pytest
from pyspark.sql import functions as F

from promptledger.operators import caching, ledger, payloads, redundancy, scrubbing
from promptledger.operators import pairs as pairing
from promptledger.plans import storage
from promptledger.sources import tables
from promptledger.sources.pricing import pricing
from promptledger.workload import views

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark):
    return tables.load_payloads(spark, f"{SF}/documents.parquet", id_column="doc_id")


ROW_LOCAL = {
    "report": payloads.payload_report,
    "warnings": payloads.warning_rows,
    "warning_counts": payloads.warning_counts,
    "findings": scrubbing.finding_rows,
    "blocked": scrubbing.blocked,
    "duplicates": redundancy.duplicate_rows,
    "compacted": redundancy.compacted,
    "sections": caching.section_rows,
    "analysis": caching.cache_analysis,
    "model_costs": payloads.model_costs,
    "removed_lines": lambda d: pairing.removed_lines(
        d.select(
            F.col("payload_id").alias("pair_id"),
            F.col("text").alias("original"),
            F.lit("x").alias("optimized"),
        )
    ),
}


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_payload_operators_do_not_shuffle(documents, name):
    plan = plan_of(ROW_LOCAL[name](documents))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_prices_are_broadcast(documents):
    priced = documents.withColumn("model", F.concat(F.lit("gpt-"), F.col("payload_id")))
    assert "BroadcastHashJoin" in plan_of(payloads.payload_report(priced))
    assert "Join" not in plan_of(payloads.payload_report(documents))


def test_small_price_lists_are_broadcast_by_their_size(spark):
    sessions = views.ledger(spark, SF)
    for operator in (payloads.known_models, payloads.unknown_models):
        assert "BroadcastHashJoin [model" in plan_of(operator(sessions, pricing(spark)))


def test_gate_filter_does_not_scrub_twice(documents):
    # The pattern is used to test, replace, extract and split, and names its parts twice.
    plan = plan_of(scrubbing.blocked(documents))
    assert plan.count("Generate inline") == 1 and plan.count("eyJ[A-Za-z0-9_-]") == 8


def test_scan_reads_only_needed_columns(documents):
    plan = plan_of(payloads.measures(documents))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_id_lookup_is_pushed_down(spark):
    path = storage.fresh_path(spark, "ledger")
    views.ledger(spark, SF).write.parquet(path)
    plan = plan_of(ledger.session_by_id(tables.load_sessions(spark, path), 42))
    assert "EqualTo(id,42)" in plan


def test_ledger_days_prune_partitions(spark):
    path = storage.fresh_path(spark, "dated-ledger")
    tables.write_sessions(views.ledger(spark, SF), path)
    found = tables.sessions_ended_on(spark, path, ["2024-01-05", "2024-01-06"])
    assert "PartitionFilters: [end_date" in plan_of(found)
    assert {str(r[0]) for r in found.select(F.to_date("ended_at")).distinct().collect()} == {
        "2024-01-05",
        "2024-01-06",
    }


ONCE = {
    "findings": scrubbing.finding_rows,
    "passed": scrubbing.passed,
    "by_type": scrubbing.findings_by_type,
    "warnings": payloads.warning_rows,
    "warning_counts": payloads.warning_counts,
    "report": payloads.payload_report,
}


@pytest.mark.parametrize("name", ONCE)
def test_each_pattern_runs_in_one_place(documents, name):
    # A pattern tests, replaces, extracts and splits; the token pattern shows up twice in each.
    assert plan_of(ONCE[name](documents)).count("eyJ[A-Za-z0-9_-]") == 8


def test_shared_blocks_shuffle_hashes_only(documents):
    df = redundancy.shared_blocks(documents)
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
    exchange = plan[plan.index("Exchange hashpartitioning") :].splitlines()[0]
    assert "text" not in exchange


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert storage.fresh_path(spark, "a") != storage.fresh_path(spark, "a")
