import random

import pytest
from pyspark.sql import functions as F

from promptledger import functions as fn
from promptledger.expressions.sections import DYNAMIC_KEYWORDS, STABLE_KEYWORDS
from promptledger.operators import caching, conversations, payloads, redundancy
from promptledger.operators import pairs as pairing
from promptledger.workload.views import BLOCK
from tests import plain_models as model

TWICE = BLOCK + "\nSome other content here.\n" + BLOCK


def line_texts(seed, count, lines):
    rng = random.Random(seed)
    return ["\n".join(rng.choices(lines, k=rng.randrange(0, 40))) for _ in range(count)]


REPEATING = line_texts(
    5, 800, ["one two three four", "Five six", "five SIX", "", "  ", " ", "seven eight  "]
)


def test_block_that_appears_twice(value_of):
    (found,) = value_of([TWICE], fn.duplicate_blocks("x", 5, 10))
    assert [tuple(r) for r in found] == [(1, 8), (2, 9)]


def test_repeats_match_a_plain_model(value_of):
    found = value_of(REPEATING, fn.duplicate_blocks("x", 5, 10))
    assert [[tuple(r) for r in rows] for rows in found] == [model.repeats(t) for t in REPEATING]


def test_short_windows_do_not_count(value_of):
    (found,) = value_of(["a\nb\nc\nd\ne\n" * 4], fn.duplicate_blocks("x", 5, 10))
    assert found == []


def test_compaction_matches_a_plain_model(value_of):
    assert value_of(REPEATING, fn.compact_text("x", 5, 10)) == [
        model.compacted(t) for t in REPEATING
    ]


def test_long_line_boundary(value_of):
    assert value_of(["x" * 500, "a\n" + "x" * 501, "é" * 251], fn.long_lines("x", 500)) == [
        [], [(2, 501)], [(1, 502)],
    ]


def test_shared_blocks_count_payloads_and_copies(texts):
    table = texts(TWICE, BLOCK, "unrelated", BLOCK.upper())
    rows = redundancy.shared_blocks(table).collect()
    whole = [r for r in rows if r.payloads == 3]
    assert {(r.first_payload, r.first_line, r.occurrences) for r in whole} >= {(0, 1, 4)}
    members = redundancy.shared_block_members(table).where("source_line = 1").collect()
    assert {(r.payload_id, r.copies) for r in members} == {(0, 2), (1, 1), (3, 1)}


def test_warnings_come_in_report_order(texts):
    text = TWICE + "\n" + "x" * 501 + "\nmail a@b.co"
    rows = payloads.warning_rows(texts(text)).orderBy("seq").collect()
    assert [r.code for r in rows] == [
        "DUPLICATE_BLOCK", "DUPLICATE_BLOCK", "LONG_LINE", "SECRET_EMAIL",
    ]
    assert [r.severity for r in rows] == ["warning", "warning", "info", "error"]
    assert rows[0].message == (
        "Lines repeat an earlier block (first at line 1, again at line 8)"
    )


def test_context_fill(texts):
    rows = payloads.warning_rows(texts("word\n" * 60_001, "word\n" * 60_000)).collect()
    assert [(r.payload_id, r.code) for r in rows] == [(0, "CONTEXT_FILL")]
    assert "60001 tokens" in rows[0].message


def test_report_costs_add_up(texts):
    table = texts("hello world " * 200, "").withColumn(
        "model", F.when(F.col("payload_id") == 0, "gpt-4o").otherwise("mystery")
    )
    first, second = payloads.payload_report(table).orderBy("payload_id").collect()
    assert first.token_count == 500 and first.estimated_output == 125
    assert first.input_cost == 500 * 2.5 / 1e6 and first.output_cost == 125 * 10.0 / 1e6
    assert first.total_cost == first.input_cost + first.output_cost
    assert (second.token_count, second.line_count, second.total_cost) == (0, 0, 0.0)
    assert second.warnings == [] and second.compression_hint == ""


MIXED = line_texts(
    6,
    800,
    ["User: hi", "You are kind", "plain", "", "  ", "ALWAYS user:", "Context: a b", "I NEED it"],
)


def test_sections_match_a_plain_model(value_of):
    found = value_of(MIXED, fn.section_list("x"))
    expected = [model.sections(t, STABLE_KEYWORDS, DYNAMIC_KEYWORDS) for t in MIXED]
    assert [[tuple(s) for s in rows] for rows in found] == expected


def test_every_line_has_a_label(value_of):
    found = value_of(MIXED, fn.line_labels("x"))
    for text, rows in zip(MIXED, found):
        assert [r.content for r in rows] == text.split("\n")
        assert [r.line for r in rows] == list(range(1, len(rows) + 1))


def test_reorder_is_recommended_only_for_dynamic_before_stable(texts):
    table = texts(
        "User: What should I do?\nYou are a helpful assistant.\nAlways follow these rules.",
        "You are an expert.\nUser: help me",
        "User: only a question",
        "",
    )
    rows = caching.cache_analysis(table).orderBy("payload_id").collect()
    assert [r.reorder_recommended for r in rows] == [True, False, False, False]
    assert (rows[0].stable_tokens, rows[0].dynamic_tokens) == (12, 5)
    assert rows[0].savings_anthropic_usd == 12 * 2.7 / 1e6
    assert len(rows[0].recommendations) == 2 and rows[2].recommendations == []
    assert (rows[3].section_count, rows[3].stable_tokens) == (0, 0)


def test_long_conversations_equal_their_assembled_text(spark):
    """One conversation holds most turns, so its chunks span several tasks."""
    rng = random.Random(9)
    roles = ["user", "assistant", "tool", "system", "tool"]
    said = ["plain", "one\ntwo", "I need\nrules: x", "", "a\n\nb", "never"]
    turns = [(0, n, rng.choice(roles), rng.choice(said)) for n in range(900)]
    turns += [(c, n, rng.choice(roles), rng.choice(said)) for c in range(1, 40) for n in range(5)]
    df = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    expected, analysed = {}, {}
    for c in range(40):
        own = sorted(t for t in turns if t[0] == c)
        text = "\n".join(f"{role}: {words}" for _, _, role, words in own)
        found = model.sections(text, STABLE_KEYWORDS, DYNAMIC_KEYWORDS)
        expected[c] = [(kind, start, end, n) for kind, _, start, end, n in found]
    got = {}
    for r in conversations.conversation_sections(df).collect():
        got.setdefault(r.conv_id, []).append((r.type, r.line_start, r.line_end, r.tokens))
    assert {c: sorted(s, key=lambda x: x[1]) for c, s in got.items()} == expected
    for r in conversations.conversation_cache(df).collect():
        analysed[r.conv_id] = (r.section_count, r.stable_tokens, r.dynamic_tokens)
    for c, found in expected.items():
        stable = sum(s[3] for s in found if s[0] == "stable")
        dynamic = sum(s[3] for s in found if s[0] == "dynamic")
        assert analysed[c] == (len(found), stable, dynamic)


@pytest.mark.parametrize("hot", [0, 700])
def test_repeats_across_turns_equal_those_of_the_assembled_text(spark, hot):
    """Windows cross turns and chunks; chunks of a short conversation hold a line or two."""
    rng = random.Random(hot)
    said = ["a b c d e\n f g h \u2003", "  i j k\n\nl m n o\n", "", "\n\n", "p Q r s t u", " ", "İ Σ v w x y"]
    turns = [(0, n, rng.choice("AB"), rng.choice(said)) for n in range(hot)]
    turns += [(c, n, "A", rng.choice(said)) for c in range(1, 9) for n in range(rng.randrange(1, 30))]
    turns += [(None, n, "A", said[n % 3]) for n in range(12)]
    kind = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    got = conversations.conversation_repeats(spark.createDataFrame(turns, kind)).collect()
    joined = {}
    for conversation, _, role, text in turns:
        joined.setdefault(conversation, []).append(f"{role}: {text}")
    prompts = spark.createDataFrame([(c, "\n".join(t)) for c, t in joined.items()], "payload_id BIGINT, text STRING")
    expected = redundancy.duplicate_rows(prompts).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected))) and got
    assert {r.conv_id for r in got} >= {None}


def test_repeats_across_turns_of_nothing_and_of_null_turns(spark):
    kind = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    assert conversations.conversation_repeats(spark.createDataFrame([], kind)).count() == 0
    block = "a b\nc d\ne f\ng h\ni j"
    turns = [(1, 0, "A", block), (1, 1, "A", None), (1, 2, None, block), (1, 3, "A", block)]
    rows = conversations.conversation_repeats(spark.createDataFrame(turns, kind)).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 6)]


def test_line_difference_keeps_multiplicity(spark):
    pairs = spark.createDataFrame(
        [(0, "keep\ngone\ngone", "keep\nnew\ngone"), (1, "same", "same"), (2, "", "a: 1\n")],
        "pair_id BIGINT, original STRING, optimized STRING",
    )

    def rows(df):
        return sorted(tuple(r) for r in df.select("pair_id", "copy", "line").collect())

    assert rows(pairing.removed_lines(pairs)) == [(0, 2, "gone")]
    assert rows(pairing.added_lines(pairs)) == [(0, 1, "new"), (2, 1, "a: 1")]
    assert rows(pairing.common_lines(pairs)) == [
        (0, 1, "gone"), (0, 1, "keep"), (1, 1, "same"), (2, 1, ""),
    ]


def test_pair_outcomes(spark):
    pairs = spark.createDataFrame(
        [(0, "word word word word", "word"), (1, "", "word"), (2, "a", "a")],
        "pair_id BIGINT, original STRING, optimized STRING",
    )
    rows = pairing.pair_delta(pairs, "gpt-4o").orderBy("pair_id").collect()
    assert [r.outcome for r in rows] == ["saved", "added", "none"]
    assert [r.percent for r in rows] == [75.0, None, 0.0]
    ratios = pairing.compression_outcome(pairs).orderBy("pair_id").collect()
    assert [r.compression_ratio for r in ratios] == [0.25, 1.0, 1.0]
