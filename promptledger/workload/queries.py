"""One entry per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.operators import (
    blockindex,
    budget,
    caching,
    conversations,
    ledger,
    payloads,
    redundancy,
    reporting,
    scrubbing,
)
from promptledger.operators import pairs as pairing
from promptledger.plans.storage import fresh_path
from promptledger.settings import Thresholds
from promptledger.sources import tables
from promptledger.sources.pricing import pricing, with_rates
from promptledger.streaming import gate
from promptledger.streaming import ledger as live
from promptledger.workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REPORT_LIMITS = Thresholds(daily_limit=2.0, session_limit=4.0, hard_stop=True)
AT = "2024-06-01 12:00:00"


def query(run: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[run.__name__] = run
    return run


def measured(spark: SparkSession, sf_dir: str, name: str, column: Column) -> DataFrame:
    """A column function of the text, applied to every document."""
    return views.documents(spark, sf_dir).select("payload_id", column.alias(name))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, "tokens", fn.token_count("text"))


def day(column: str = "date") -> Column:
    return F.col(column).cast("string")


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


# --- sources and sinks -------------------------------------------------------------


@query
def payload_scan(spark, sf_dir):
    found = tables.load_payloads(spark, f"{sf_dir}/documents.parquet", id_column="doc_id")
    return found.select(
        "payload_id",
        F.length("text").cast("bigint").alias("characters"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


@query
def pair_scan(spark, sf_dir):
    joined = tables.load_pairs(views.documents(spark, sf_dir), views.planted(spark, sf_dir))
    return joined.select(
        "pair_id",
        F.length("original").cast("bigint").alias("original_length"),
        F.length("optimized").cast("bigint").alias("optimized_length"),
    )


@query
def pricing_dim(spark, sf_dir):
    used = views.ledger(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("sessions"))
    return with_rates(used)


@query
def sink_clean_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "clean")
    tables.write_clean(scrubbing.redacted(views.planted(spark, sf_dir)), path)
    stored = tables.load_payloads(spark, path)
    return stored.select("payload_id", digest("text").alias("sha256"))


@query
def report_json(spark, sf_dir):
    path = fresh_path(spark, "report-json")
    report = reporting.session_report(views.ledger(spark, sf_dir))
    tables.write_json(report, path)
    stored = tables.read_json(spark, path, report.schema)
    return stored.select(
        "id",
        stamp("started_at").alias("started_at"),
        stamp("ended_at").alias("ended_at"),
        "model",
        "tag",
        "tokens_in",
        "tokens_out",
        "tokens_cached",
        "cost_usd",
        "cache_hit_ratio",
        "cache_savings_usd",
    )


@query
def report_csv(spark, sf_dir):
    path = fresh_path(spark, "report-csv")
    tables.write_csv(reporting.session_report(views.ledger(spark, sf_dir)), path)
    return tables.read_csv_report(spark, path)


@query
def audit_hash(spark, sf_dir):
    return tables.audit_log(views.documents(spark, sf_dir)).select("sha256")


# --- measures and filters ----------------------------------------------------------


@query
def token_count(spark, sf_dir):
    return measured(spark, sf_dir, "token_count", fn.token_count("text"))


@query
def word_count(spark, sf_dir):
    return measured(spark, sf_dir, "word_count", fn.word_count("text"))


@query
def line_count(spark, sf_dir):
    return measured(spark, sf_dir, "line_count", fn.line_count("text"))


@query
def est_output(spark, sf_dir):
    output = fn.projected_output("tokens").alias("est_output")
    return counted(spark, sf_dir).select("payload_id", output)


@query
def compression_hint(spark, sf_dir):
    hint = fn.shortening_hint("tokens").alias("compression_hint")
    return counted(spark, sf_dir).select("payload_id", hint)


@query
def format_tokens(spark, sf_dir):
    shown = fn.format_tokens("tokens").alias("format_tokens")
    return counted(spark, sf_dir).select("payload_id", shown)


@query
def code_heavy(spark, sf_dir):
    both = views.documents(spark, sf_dir).unionByName(
        views.pages(spark, sf_dir).withColumn("payload_id", -F.col("payload_id") - 1)
    )
    return payloads.symbol_heavy(both)


@query
def long_lines(spark, sf_dir):
    return payloads.long_line_rows(views.planted(spark, sf_dir))


@query
def context_fill(spark, sf_dir):
    return payloads.overfull(views.planted(spark, sf_dir))


@query
def format_cost(spark, sf_dir):
    costs = payloads.model_costs(views.documents(spark, sf_dir))
    return costs.select(
        "payload_id",
        "model",
        fn.format_cost("input_cost").alias("input_cost"),
        fn.format_cost("(output_cost * 1000)").alias("output_cost_per_thousand"),
    )


def flat_report(report: DataFrame) -> DataFrame:
    """The payload report with its lists as counts and one text."""
    lines = F.expr(
        "transform(warnings, w -> concat_ws('|', w.severity, w.code, CAST(w.line AS STRING), "
        "w.message, w.hint))"
    )
    return report.select(
        "payload_id",
        "model",
        "token_count",
        "word_count",
        "line_count",
        "estimated_output",
        "input_cost",
        "output_cost",
        "total_cost",
        F.size("warnings").cast("bigint").alias("warning_count"),
        F.array_join(lines, "\n").alias("warnings"),
        F.size("findings").cast("bigint").alias("finding_count"),
        "has_secrets",
        "compression_hint",
    )


@query
def payload_report(spark, sf_dir):
    return flat_report(payloads.payload_report(views.planted(spark, sf_dir)))


# --- costs -------------------------------------------------------------------------


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = views.ledger(spark, sf_dir)
    return sessions.select(
        "id",
        "model",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(name).alias("direction"), F.col(column).alias("tokens"))
                    for name, column in (
                        ("input", "tokens_in"),
                        ("Output", "tokens_out"),
                        ("CACHED", "tokens_cached"),
                        ("inbound", "tokens_out"),
                    )
                )
            )
        ),
    )


@query
def cost_by_direction(spark, sf_dir):
    known = usage(spark, sf_dir).where("direction <> 'inbound'")
    return payloads.cost_by_direction(known, "tokens", "direction")


@query
def cost_by_name(spark, sf_dir):
    return payloads.cost_by_direction(usage(spark, sf_dir), "tokens", "direction")


@query
def known_models(spark, sf_dir):
    found = payloads.known_models(views.ledger(spark, sf_dir), pricing(spark))
    return found.select("id", "model")


@query
def unknown_models(spark, sf_dir):
    found = payloads.unknown_models(views.ledger(spark, sf_dir), pricing(spark))
    return found.select("id", "model")


@query
def model_cost_matrix(spark, sf_dir):
    return payloads.model_costs(views.documents(spark, sf_dir))


# --- secrets -----------------------------------------------------------------------


@query
def redact(spark, sf_dir):
    clean = scrubbing.redacted(views.planted(spark, sf_dir))
    return clean.select("payload_id", digest("text").alias("sha256"))


@query
def redact_subset(spark, sf_dir):
    clean = scrubbing.redacted(views.planted(spark, sf_dir), ("email", "ssn"))
    return clean.select("payload_id", digest("text").alias("sha256"))


@query
def findings(spark, sf_dir):
    found = scrubbing.finding_rows(views.planted(spark, sf_dir))
    return found.select("payload_id", "seq", "type", "redacted", "is_redacted")


@query
def finding_lines(spark, sf_dir):
    found = scrubbing.finding_rows(views.planted(spark, sf_dir))
    return found.select("payload_id", "seq", "line")


@query
def finding_display(spark, sf_dir):
    found = scrubbing.finding_rows(views.planted(spark, sf_dir))
    return found.select("payload_id", "seq", "match")


@query
def shannon_entropy(spark, sf_dir):
    return views.pages(spark, sf_dir).select(
        "payload_id", fn.shannon_entropy("text").alias("entropy")
    )


@query
def high_entropy(spark, sf_dir):
    both = views.planted(spark, sf_dir).unionByName(
        views.pages(spark, sf_dir).withColumn("payload_id", -F.col("payload_id") - 1)
    )
    return scrubbing.high_entropy_rows(both, 4.2).select("payload_id", "line", "match")


@query
def gate_clean(spark, sf_dir):
    return scrubbing.passed(views.planted(spark, sf_dir)).select("payload_id")


@query
def gate_blocked(spark, sf_dir):
    return scrubbing.blocked(views.planted(spark, sf_dir)).select(
        "payload_id", digest("clean").alias("sha256")
    )


@query
def findings_by_type(spark, sf_dir):
    return scrubbing.findings_by_type(views.planted(spark, sf_dir))


# --- redundancy and warnings -------------------------------------------------------


@query
def duplicate_blocks(spark, sf_dir):
    return redundancy.duplicate_rows(views.planted(spark, sf_dir))


@query
def corpus_duplicate_blocks(spark, sf_dir):
    return redundancy.shared_blocks(views.planted(spark, sf_dir)).drop("key", "key2")


@query
def corpus_duplicate_members(spark, sf_dir):
    return redundancy.shared_block_members(views.planted(spark, sf_dir))


def indexed_documents(spark, sf_dir):
    """An index of all documents, and shortened versions of all of them, which it lacks."""
    index = blockindex.BlockIndex(spark, fresh_path(spark, "block-index"))
    index.add(views.planted(spark, sf_dir), "documents")
    return index, views.optimized(spark, sf_dir)


@query
def indexed_blocks(spark, sf_dir):
    index, versions = indexed_documents(spark, sf_dir)
    index.add(versions, "versions")
    return index.shared().drop(*blockindex.KEY)


@query
def known_blocks(spark, sf_dir):
    index, versions = indexed_documents(spark, sf_dir)
    return index.known_in(versions)


@query
def warnings(spark, sf_dir):
    return payloads.warning_rows(views.planted(spark, sf_dir))


@query
def warning_counts(spark, sf_dir):
    return payloads.warning_counts(views.planted(spark, sf_dir))


@query
def compact_payloads(spark, sf_dir):
    found = redundancy.compacted(views.planted(spark, sf_dir))
    return found.select(
        "payload_id",
        digest("text").alias("sha256"),
        "original_tokens",
        "compacted_tokens",
        "tokens_saved",
    )


# --- pairs -------------------------------------------------------------------------


@query
def pair_delta(spark, sf_dir):
    return pairing.pair_delta(views.pairs(spark, sf_dir))


@query
def pair_report(spark, sf_dir):
    found = pairing.pair_report(views.pairs(spark, sf_dir))
    return found.select(
        "pair_id",
        "token_delta",
        "cost_delta",
        F.array_join("removed_lines", "\n").alias("removed_lines"),
        F.array_join("added_lines", "\n").alias("added_lines"),
    )


@query
def compression_outcome(spark, sf_dir):
    return pairing.compression_outcome(views.pairs(spark, sf_dir))


@query
def removed_lines(spark, sf_dir):
    return pairing.removed_lines(views.pairs(spark, sf_dir))


@query
def added_lines(spark, sf_dir):
    return pairing.added_lines(views.pairs(spark, sf_dir))


@query
def common_lines(spark, sf_dir):
    return pairing.common_lines(views.pairs(spark, sf_dir))


@query
def compression_requests(spark, sf_dir):
    found = pairing.compression_requests(views.documents(spark, sf_dir), "local-model")
    parsed = F.from_json(
        "request",
        "model STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, max_tokens BIGINT",
    )
    return found.select("payload_id", parsed.alias("r")).select(
        "payload_id",
        F.col("r.model").alias("model"),
        F.col("r.max_tokens").alias("max_tokens"),
        F.sha2(F.col("r.messages")[0]["content"].cast("binary"), 256).alias("prompt_sha256"),
    )


# --- sections ----------------------------------------------------------------------


@query
def line_labels(spark, sf_dir):
    found = caching.label_rows(views.planted(spark, sf_dir))
    return found.select("payload_id", "line", "type")


@query
def sections(spark, sf_dir):
    found = caching.section_rows(views.planted(spark, sf_dir))
    return found.select(
        "payload_id",
        "section_no",
        "type",
        "line_start",
        "line_end",
        digest("content").alias("sha256"),
    )


@query
def section_tokens(spark, sf_dir):
    found = caching.section_rows(views.planted(spark, sf_dir))
    return found.select("payload_id", "section_no", "tokens")


def analysis(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return caching.cache_analysis(views.planted(spark, sf_dir)).select("payload_id", *columns)


@query
def cache_totals(spark, sf_dir):
    return analysis(spark, sf_dir, "stable_tokens", "dynamic_tokens")


@query
def cache_savings(spark, sf_dir):
    return analysis(spark, sf_dir, "savings_anthropic_usd", "savings_openai_usd")


@query
def reorder_flag(spark, sf_dir):
    return analysis(spark, sf_dir, "reorder_recommended")


def joined_texts(found: DataFrame) -> DataFrame:
    return found.withColumn("recommendations", F.array_join("recommendations", "\n"))


@query
def cache_recommendations(spark, sf_dir):
    return joined_texts(analysis(spark, sf_dir, "recommendations"))


@query
def cache_analysis(spark, sf_dir):
    found = caching.cache_analysis(views.planted(spark, sf_dir))
    return joined_texts(found.drop("sections"))


@query
def conversation_labels(spark, sf_dir):
    found = conversations.conversation_lines(views.turns(spark, sf_dir))
    return found.select("conv_id", "line", "type")


@query
def conversation_sections(spark, sf_dir):
    return conversations.conversation_sections(views.turns(spark, sf_dir))


@query
def conversation_duplicate_blocks(spark, sf_dir):
    return conversations.conversation_repeats(views.planted_turns(spark, sf_dir))


@query
def conversation_cache(spark, sf_dir):
    return joined_texts(conversations.conversation_cache(views.turns(spark, sf_dir)))


# --- ledger ------------------------------------------------------------------------

SESSION_COLUMNS = (
    "id",
    "session_uuid",
    "model",
    "tag",
    "tokens_in",
    "tokens_out",
    "tokens_cached",
    "cost_usd",
    "warning_count",
)


def shown_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        *SESSION_COLUMNS,
        stamp("started_at").alias("started_at"),
        stamp("ended_at").alias("ended_at"),
    )


def shown_days(daily: DataFrame) -> DataFrame:
    return daily.withColumn("date", day())


@query
def session_fold(spark, sf_dir):
    events = views.ledger_events(views.ledger(spark, sf_dir))
    return shown_sessions(ledger.fold_sessions(events))


@query
def session_by_id(spark, sf_dir):
    return shown_sessions(ledger.session_by_id(views.ledger(spark, sf_dir), 42))


@query
def session_last(spark, sf_dir):
    return shown_sessions(ledger.last_session(views.ledger(spark, sf_dir)))


@query
def sessions_newest(spark, sf_dir):
    return shown_sessions(ledger.newest_first(views.ledger(spark, sf_dir)))


@query
def sessions_selected(spark, sf_dir):
    return shown_sessions(ledger.select_sessions(views.ledger(spark, sf_dir), "all", "purchase"))


@query
def daily_spend(spark, sf_dir):
    return shown_days(ledger.daily_spend(views.ledger(spark, sf_dir)))


@query
def daily_upsert(spark, sf_dir):
    sessions = views.ledger(spark, sf_dir)
    stored = ledger.daily_spend(sessions.where("tag <> 'purchase'"))
    new = ledger.daily_spend(sessions.where("tag = 'purchase'"))
    return shown_days(ledger.upsert_daily(stored, new))


@query
def daily_reset(spark, sf_dir):
    daily = ledger.daily_spend(views.ledger(spark, sf_dir))
    mondays = views.days_of(spark, sf_dir).where(F.dayofweek("date") == 2)
    return shown_days(ledger.reset_days(daily, mondays))


@query
def spend_on_day(spark, sf_dir):
    daily = ledger.daily_spend(views.ledger(spark, sf_dir))
    asked = views.days_of(spark, sf_dir).select(F.date_add("date", 15).alias("date"))
    return shown_days(ledger.spend_on(daily, asked))


@query
def schema_evolve(spark, sf_dir):
    sessions = views.ledger(spark, sf_dir)
    older = sessions.where("ended_at IS NOT NULL").drop("session_uuid", "warning_count")
    newer = sessions.where("ended_at IS NULL").withColumn("warning_count", F.col("id") % 5)
    both = ledger.evolve(older, newer)
    return both.select("id", "session_uuid", "model", "tokens_in", "cost_usd", "warning_count")


@query
def uuid_duplicates(spark, sf_dir):
    events = views.ledger_events(views.ledger(spark, sf_dir))
    repeated = events.withColumn("session_uuid", F.when(F.col("kind") == "end", F.col("session_uuid")))
    return ledger.duplicate_keys(repeated)


@query
def analysis_ledger(spark, sf_dir):
    at = F.to_timestamp(F.lit(AT))
    rows = ledger.analysis_sessions(views.planted(spark, sf_dir), "corpus", at=at)
    return shown_sessions(rows)


# --- reports -----------------------------------------------------------------------


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.session_report(views.ledger(spark, sf_dir))


@query
def cache_hit_ratio(spark, sf_dir):
    return report(spark, sf_dir).select("id", "cache_hit_ratio")


@query
def realised_savings(spark, sf_dir):
    return report(spark, sf_dir).select("id", "model", "cache_savings_usd")


@query
def session_report(spark, sf_dir):
    return report(spark, sf_dir).select(
        *SESSION_COLUMNS,
        "cache_hit_ratio",
        "cache_savings_usd",
        stamp("started_at").alias("started_at"),
        stamp("ended_at").alias("ended_at"),
    )


@query
def report_total(spark, sf_dir):
    return reporting.report_total(report(spark, sf_dir))


@query
def cost_by_tag(spark, sf_dir):
    return reporting.cost_by(report(spark, sf_dir), "tag")


@query
def cost_by_model(spark, sf_dir):
    return reporting.cost_by(report(spark, sf_dir), "model")


@query
def cost_by_day(spark, sf_dir):
    ended = reporting.with_end_day(report(spark, sf_dir))
    return shown_days(reporting.cost_by(ended, "date"))


@query
def cost_rollup(spark, sf_dir):
    return reporting.cost_rollup(report(spark, sf_dir), "model", "tag")


@query
def cost_cube(spark, sf_dir):
    return reporting.cost_cube(report(spark, sf_dir), "model", "tag")


@query
def savings_vs_baseline(spark, sf_dir):
    return shown_days(reporting.savings_vs_baseline(report(spark, sf_dir)))


# --- budget ------------------------------------------------------------------------


@query
def budget_status(spark, sf_dir):
    daily = ledger.daily_spend(views.ledger(spark, sf_dir))
    return shown_days(budget.budget_status(daily, REPORT_LIMITS))


@query
def budget_state(spark, sf_dir):
    daily = ledger.daily_spend(views.ledger(spark, sf_dir))
    return shown_days(budget.budget_state(daily, REPORT_LIMITS))


@query
def budget_breach(spark, sf_dir):
    found = budget.first_breach(views.ledger(spark, sf_dir), REPORT_LIMITS)
    return shown_days(found).withColumn("ended_at", stamp("ended_at"))


@query
def spend_ticks(spark, sf_dir):
    return shown_days(budget.spend_ticks(views.ledger(spark, sf_dir), 900))


@query
def burn_rate(spark, sf_dir):
    return shown_days(budget.burn_rate(views.ledger(spark, sf_dir), 900))


@query
def burn_projection(spark, sf_dir):
    return shown_days(budget.burn_projection(views.ledger(spark, sf_dir), 3600))


@query
def session_budget(spark, sf_dir):
    return budget.session_budget(views.ledger(spark, sf_dir), REPORT_LIMITS)


# --- streams -----------------------------------------------------------------------


def folders(spark, name):
    """Fresh folders for the progress and the output of one run."""
    return fresh_path(spark, f"{name}-progress"), fresh_path(spark, name)


@query
def stream_daily_spend(spark, sf_dir):
    stream = views.ledger_stream(spark, sf_dir)
    return shown_days(live.stream_daily_spend(stream, *folders(spark, "daily")))


@query
def stream_alerts(spark, sf_dir):
    stream = views.ledger_stream(spark, sf_dir)
    alerts = live.stream_alerts(stream, *folders(spark, "alerts"), 3600, REPORT_LIMITS)
    return shown_days(alerts)


@query
def stream_daily_upsert(spark, sf_dir):
    """Every ended session as a daily row of its own."""
    sessions = views.ledger_stream(spark, sf_dir).where(F.col("ended_at").isNotNull())
    daily = sessions.select(
        F.to_date("ended_at").alias("date"), "cost_usd", ledger.tokens_total().alias("tokens_total")
    )
    return shown_days(live.stream_daily_upsert(daily, *folders(spark, "upsert")))


@query
def stream_scrub(spark, sf_dir):
    found = gate.stream_scrub(views.planted_stream(spark, sf_dir), *folders(spark, "scrub"))
    return found.select("payload_id", digest("text").alias("sha256"), "findings", "blocked")


@query
def stream_ledger_dedup(spark, sf_dir):
    """Every session ends twice, first an hour earlier at another cost."""
    sessions = views.ledger_stream(spark, sf_dir)
    early = F.struct(
        (F.col("ended_at") - F.expr("INTERVAL 1 HOUR")).alias("ended_at"), (F.col("cost_usd") + 1).alias("cost_usd")
    )
    ends = F.explode(F.array(early, F.struct("ended_at", "cost_usd")))
    twice = sessions.withColumn("end", ends).withColumns(
        {"ended_at": F.col("end.ended_at"), "cost_usd": F.col("end.cost_usd")}
    )
    unique = live.stream_unique_sessions(twice.drop("end"), *folders(spark, "sessions"))
    return shown_days(ledger.daily_spend(unique))
