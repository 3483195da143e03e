import pytest

from promptledger.operators import reporting, scrubbing
from promptledger.plans.storage import fresh_path
from promptledger.operators import ledger
from promptledger.sources import tables
from promptledger.workload import views

SF = "/root/testdata/sf0.001"


def test_whole_files_are_payloads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("mail a@b.co")
    rows = tables.load_payloads(spark, str(tmp_path), "text").collect()
    assert sorted(r.text for r in rows) == ["mail a@b.co", "one\ntwo\n"]
    assert len({r.payload_id for r in rows}) == len(rows) and all(isinstance(r.payload_id, int) for r in rows)


def test_json_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"payload_id": 1, "text": "hi"}\n')
    rows = tables.load_payloads(spark, str(tmp_path), "json").collect()
    assert [tuple(r) for r in rows] == [(1, "hi")]


def test_pairs_join_on_key(texts):
    pairs = tables.load_pairs(texts("a", "b"), texts("c"))
    assert [tuple(r) for r in pairs.collect()] == [(0, "a", "c")]


def test_clean_roundtrip(spark, texts):
    path = fresh_path(spark, "clean")
    tables.write_clean(scrubbing.redacted(texts("mail a@b.co")), path)
    assert tables.load_payloads(spark, path).first().text == "mail [REDACTED:EMAIL]"


def test_csv_report_has_its_header_and_formats(spark):
    path = fresh_path(spark, "csv")
    report = reporting.session_report(views.ledger(spark, SF)).where("id = 4")
    tables.write_csv(report, path)
    header, line = [r.value for r in spark.read.text(path).coalesce(1).collect()]
    assert header.split(",") == list(tables.CSV_COLUMNS)
    assert line.split(",")[3].endswith("Z") and len(line.split(",")[7].split(".")[1]) == 6


def test_audit_lines_hold_hashes_only(spark, texts):
    path = fresh_path(spark, "audit")
    tables.append_audit_log(texts("hello"), path)
    tables.append_audit_log(texts("hello"), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    digest = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert len(lines) == 2 and all(x.endswith(f"Z sha256={digest}") for x in lines)


def test_text_files_become_ledger_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some words")
    payloads = tables.load_payloads(spark, str(tmp_path / "in"), "text")
    sessions = ledger.analysis_sessions(payloads, "files")
    tables.write_sessions(sessions, str(tmp_path / "ledger"))
    assert tables.load_sessions(spark, str(tmp_path / "ledger")).first().tag == "files"


def test_other_types_are_refused(spark, tmp_path):
    wrong = spark.sql("SELECT 'x' AS id, current_timestamp() AS ended_at")
    with pytest.raises(ValueError, match="id"):
        tables.write_sessions(wrong, str(tmp_path / "ledger"))


def test_model_of_each_payload(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT 1L AS payload_id, 'a b' AS text, 'gpt-4o' AS m").write.parquet(path)
    assert tables.load_payloads(spark, path, model_column="m").first().model == "gpt-4o"


def test_text_files_stream_with_the_ids_they_load_with(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo\n"), ("b c.txt", "mail a@b.co"), ("d.txt", "")):
        (tmp_path / name).write_text(text)
    loaded = {r.payload_id: r.text for r in tables.load_payloads(spark, str(tmp_path), "text").collect()}
    out, progress = fresh_path(spark, "whole-files"), fresh_path(spark, "progress")
    arriving = tables.stream_payloads(spark, str(tmp_path), "text")
    query = arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
    query.trigger(availableNow=True).start().awaitTermination()
    assert {r.payload_id: r.text for r in spark.read.parquet(out).collect()} == loaded
    assert "one\ntwo\n" in loaded.values()


def test_payloads_dealt_to_partitions(spark, texts):
    path = fresh_path(spark, "one-file")
    texts(*map(str, range(40))).coalesce(1).write.parquet(path)
    dealt = tables.load_payloads(spark, path, partitions=5)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 40
    assert tables.load_payloads(spark, path).rdd.getNumPartitions() == 1


def test_clean_text_in_folders(spark, texts):
    path = fresh_path(spark, "clean-by")
    cleaned = scrubbing.redacted(texts("a", "b")).selectExpr("*", "payload_id % 2 AS part")
    tables.write_clean(cleaned, path, partition_by=["part"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(0, "a", 0), (1, "b", 1)]
    assert [tuple(r) for r in spark.read.parquet(f"{path}/part=1").collect()] == [(1, "b")]


@pytest.mark.parametrize("key", ["id", "session_uuid"])
def test_a_lookup_reads_the_row_groups_that_may_hold_the_key(spark, key):
    """Sessions of fifty files, each over the whole range of keys."""
    path = fresh_path(spark, "ledger-files")
    rows = spark.range(20_000).selectExpr(
        "id * 7 AS id", "concat('u', md5(cast(id AS STRING))) AS session_uuid",
        "timestamp'2024-01-01' AS started_at", "timestamp'2024-01-02' AS ended_at", "'m' AS model", "'t' AS tag",
        "1L AS tokens_in", "1L AS tokens_out", "1L AS tokens_cached", "1.0D AS cost_usd", "0L AS warning_count", "'' AS notes",
    )
    tables.write_sessions(rows.repartition(50, "session_uuid"), path)
    wanted = rows.where("id = 7 * 1234").first()
    found = tables.load_sessions(spark, path).where(f"{key} = {wanted[key]!r}")
    plan = found._jdf.queryExecution().executedPlan()
    assert [r.id for r in found.collect()] == [wanted.id]
    leaf = plan.collectLeaves().head()
    read = leaf.metrics().apply("numOutputRows").value() if leaf.metrics().contains("numOutputRows") else -1
    assert 1 <= read <= 3 * 20_000 // 50
