import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promptledger.operators import budget, ledger, payloads, reporting
from promptledger.plans.ordered import running_sums
from promptledger.settings import Thresholds
from promptledger.sources.pricing import PRICES, pricing
from promptledger.sources.tables import SESSION_SCHEMA

DAY = dt.datetime(2024, 3, 1)


def at(hours, day=0):
    return DAY + dt.timedelta(days=day, hours=hours)


def session(number, end, cost=0.0, model="gpt-4o", tag="t", tokens=(0, 0, 0), warnings=0):
    return (number, f"u{number}", at(0), end, model, tag, *tokens, cost, warnings, "")


@pytest.fixture
def sessions(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SESSION_SCHEMA)


EVENTS = (
    "id BIGINT, session_uuid STRING, kind STRING, event_no INT, at TIMESTAMP, model STRING, "
    "tag STRING, tokens_in BIGINT, tokens_out BIGINT, tokens_cached BIGINT, cost_usd DOUBLE, "
    "warning_count BIGINT"
)


def test_fold_takes_the_last_end_and_keeps_open_sessions(spark):
    events = spark.createDataFrame(
        [
            (1, "a", "start", 0, at(1), "gpt-4o", "x", None, None, None, None, None),
            (1, "a", "end", 1, at(2), "gpt-4o", "x", 500, 100, 50, 0.01, None),
            (1, "a", "end", 2, at(3), "gpt-4o", "x", 1000, 250, 100, 0.0035, None),
            (1, "a", "analysis", 3, at(3), "gpt-4o", "x", None, None, None, None, 4),
            (2, "b", "start", 0, at(5), "gpt-4o", "y", None, None, None, None, None),
        ],
        EVENTS,
    )
    done, still_open = ledger.fold_sessions(events).orderBy("id").collect()
    assert (done.tokens_in, done.tokens_out, done.tokens_cached) == (1000, 250, 100)
    assert (done.cost_usd, done.warning_count, done.ended_at) == (0.0035, 4, at(3))
    assert (still_open.ended_at, still_open.tokens_in, still_open.warning_count) == (None, 0, 0)


def test_lookup_and_order(sessions):
    table = sessions(*(session(n, at(n)) for n in (3, 1, 2)))
    assert [r.id for r in ledger.newest_first(table).collect()] == [3, 2, 1]
    assert [r.id for r in ledger.last_session(table).collect()] == [3]
    assert [r.id for r in ledger.session_by_id(table, 2).collect()] == [2]
    assert ledger.last_session(table.limit(0)).collect() == []
    chosen = {w: [r.id for r in ledger.select_sessions(table, w).collect()] for w in ("all", "last", "1")}
    assert chosen == {"all": [3, 2, 1], "last": [3], "1": [1]}


def test_daily_spend_counts_cached_tokens_of_ended_sessions(sessions):
    table = sessions(
        session(1, at(1), 0.005, tokens=(500, 100, 200)),
        session(2, at(23.99), 0.001),
        session(3, at(24), 0.002, tokens=(1, 1, 1)),
        session(4, None),
    )
    rows = ledger.daily_spend(table).orderBy("date").collect()
    assert [(str(r.date), r.cost_usd, r.tokens_total) for r in rows] == [
        ("2024-03-01", 0.006, 800),
        ("2024-03-02", 0.002, 3),
    ]


def test_upsert_equals_rollup_of_everything(sessions):
    rows = [session(n, at(n % 60), n / 1000, tokens=(n, 1, 2)) for n in range(1, 90)]
    first, second = sessions(*rows[:50]), sessions(*rows[50:])
    merged = ledger.upsert_daily(ledger.daily_spend(first), ledger.daily_spend(second))
    whole = ledger.daily_spend(sessions(*rows))
    assert sorted(merged.collect()) == sorted(whole.collect())


def test_reset_and_lookup_of_days(spark, sessions):
    daily = ledger.daily_spend(sessions(session(1, at(1), 1.0), session(2, at(25), 2.0)))
    days = spark.sql("SELECT DATE'2024-03-01' AS date UNION ALL SELECT DATE'2024-05-05'")
    assert [str(r.date) for r in ledger.reset_days(daily, days).collect()] == ["2024-03-02"]
    spent = {str(r.date): (r.cost_usd, r.tokens_total) for r in ledger.spend_on(daily, days).collect()}
    assert spent == {"2024-03-01": (1.0, 0), "2024-05-05": (0.0, 0)}


def test_schema_evolution_and_key_check(sessions):
    table = sessions(session(1, at(1)), session(2, at(2), warnings=3))
    older = table.where("id = 1").drop("session_uuid", "warning_count")
    rows = ledger.evolve(older, table.where("id = 2")).orderBy("id").collect()
    assert [(r.session_uuid, r.warning_count) for r in rows] == [(None, 0), ("u2", 3)]
    doubled = table.unionByName(table.where("id = 1"))
    nulls = table.withColumn("session_uuid", F.lit(None).cast("string"))
    assert [tuple(r) for r in ledger.duplicate_keys(doubled.unionByName(nulls)).collect()] == [("u1", 2)]


def test_analysis_becomes_a_session(texts):
    (row,) = ledger.analysis_sessions(texts("mail a@b.co"), "pr-1").collect()
    assert (row.tag, row.tokens_in, row.tokens_out, row.tokens_cached) == ("pr-1", 3, 1, 0)
    assert row.warning_count == 1 and row.ended_at is not None


def test_cache_metrics(sessions):
    table = sessions(
        session(1, at(1), model="claude-sonnet-4-5", tokens=(900, 0, 100)),
        session(2, at(1), model="mystery", tokens=(900, 0, 100)),
        session(3, at(1), tokens=(0, 0, 0)),
    )
    rows = reporting.session_report(table).orderBy("id").collect()
    assert [r.cache_hit_ratio for r in rows] == [0.1, 0.1, 0.0]
    assert [r.cache_savings_usd for r in rows] == [100 * 2.70 / 1e6, 0.0, 0.0]


def test_total_needs_two_sessions(sessions):
    two = reporting.session_report(sessions(session(1, at(1), 0.25), session(2, None, 0.5)))
    assert [r.cost_usd for r in reporting.report_total(two).collect()] == [0.75]
    assert reporting.report_total(two.limit(1)).collect() == []


@pytest.mark.parametrize("model", [*PRICES, "mystery"])
def test_costs_by_direction_name(spark, model):
    rates = dict(zip(("input", "Output", "CACHED"), PRICES.get(model, (0.0, 0.0, 0.0))))
    rates["inbound"] = rates["input"]
    usage = spark.createDataFrame(
        [(model, d, 1000) for d in rates], "model STRING, direction STRING, tokens BIGINT"
    )
    rows = payloads.cost_by_direction(usage, "tokens", "direction").collect()
    assert {r.direction: r.cost_usd for r in rows} == {
        d: 1000 * rate / 1_000_000 for d, rate in rates.items()
    }


def test_own_price_table(spark):
    usage = spark.sql("SELECT 'm' AS model, 'input' AS direction, 2000000L AS tokens")
    own = spark.sql("SELECT 'm' AS model, 7D AS input_per_1m, 0D AS output_per_1m, 0D AS cached_per_1m")
    assert payloads.cost_by_direction(usage, "tokens", "direction", own).first().cost_usd == 14.0
    assert pricing(spark).count() == 10


def test_budget_states(spark):
    daily = spark.createDataFrame(
        [(dt.date(2024, 3, n), cost, 1) for n, cost in ((1, 7.99), (2, 8.0), (3, 10.0))],
        "date DATE, cost_usd DOUBLE, tokens_total BIGINT",
    )
    rows = budget.budget_state(daily, Thresholds(hard_stop=True)).orderBy("date").collect()
    assert [(r.state, r.stop) for r in rows] == [("ok", False), ("warn", False), ("exceeded", True)]
    free = budget.budget_state(daily, Thresholds(daily_limit=0)).collect()
    assert {(r.used_percent, r.state) for r in free} == {(0.0, "ok")}


def test_first_breach_of_each_level(sessions):
    table = sessions(
        *(session(n, at(1 + n / 3600), 1.0) for n in range(1, 13)),
        session(50, at(30), 9.0),
        session(60, at(50), 1.0),
    )
    rows = {(str(r.date), r.level): (r.id, r.spend_usd) for r in budget.first_breach(table).collect()}
    assert rows == {
        ("2024-03-01", "warn"): (8, 8.0),
        ("2024-03-01", "exceeded"): (10, 10.0),
        ("2024-03-02", "warn"): (50, 9.0),
    }


def test_ticks_burn_and_projection(sessions):
    table = sessions(
        session(1, at(1.5), 1.0, tokens=(10, 0, 0)),
        session(2, at(3.5), 2.0),
        session(3, at(24.5), 5.0),
    )
    rows = budget.burn_projection(table, 3600).orderBy("date", "tick").collect()
    assert len(rows) == 48
    spend = [r.spend_usd for r in rows]
    assert spend[:5] == [0.0, 1.0, 1.0, 3.0, 3.0] and spend[23] == 3.0 and spend[24] == 5.0
    burn = {i: r.burn_usd_per_hour for i, r in enumerate(rows) if r.burn_usd_per_hour}
    assert burn == {1: 1.0, 3: 2.0, 24: 2.0}
    assert rows[3].projected_usd == 3.0 + 8 * 2.0 and rows[4].projected_usd is None
    assert rows[1].tokens_today == 10
    with pytest.raises(ValueError):
        budget.spend_ticks(table, 7000)


def test_running_sums_with_a_hot_group_and_null_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), n, rng.randrange(100) / 7) for n in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, n INT, v DOUBLE")
    result = running_sums(df, ["g"], ["n"], {"total": "v"}).collect()
    assert len(result) == 3000
    expected, sums = {}, {}
    for g, n, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, Decimal(0)) + Decimal(repr(v)).quantize(Decimal("1e-10"))
        expected[n] = sums[g]
    assert {r.n: r.total for r in result} == expected


def test_last_running_sum_is_the_daily_total(sessions):
    table = sessions(*(session(n, at(n / 50), n / 997) for n in range(1, 1100)))
    spent = budget.session_budget(table).agg(F.max("spent_usd")).first()[0]
    assert spent == reporting.report_total(reporting.session_report(table).withColumn("cache_savings_usd", F.lit(0.0))).first().cost_usd
