"""The stored block index: additions, repeated and killed ones, and how they are planned."""

import random

import pytest

from promptledger.operators import redundancy
from promptledger.operators.blockindex import BlockIndex
from promptledger.plans.storage import fresh_path
from promptledger.settings import Thresholds

LINES = ["one two three four", "Five six", "five SIX", "", "seven eight  ", "nine ten eleven"]


def corpus(spark, seed, ids):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choices(LINES, k=rng.randrange(0, 30)))) for i in ids]
    return spark.createDataFrame([*rows, (max(ids) + 1, None)], "payload_id BIGINT, text STRING")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def index(spark):
    return BlockIndex(spark, fresh_path(spark, "block-index"))


def test_additions_equal_the_whole(spark, index):
    parts = [corpus(spark, n, range(at, at + 60)) for n, at in enumerate((400, 100, 700, 0))]
    assert index.blocks().count() == 0 and index.known_in(parts[0]).count() == 0
    whole = parts[0].limit(0)
    for n, part in enumerate(parts):
        assert index.add(part, f"part {n}")
        whole = whole.unionAll(part)
        assert rows(index.shared()) == rows(redundancy.shared_blocks(whole))
    assert not index.add(parts[1], "part 1")
    assert rows(index.shared()) == rows(redundancy.shared_blocks(whole))


def test_a_null_id_and_an_empty_addition(spark, index):
    block = "a b c\nd e f\ng h i\nj k l\nm n o"
    kind = "payload_id BIGINT, text STRING"
    assert index.add(spark.createDataFrame([], kind), "none") and index.blocks().count() == 0
    assert index.add(spark.createDataFrame([(None, block)], kind), "null")
    assert index.add(spark.createDataFrame([(5, "x\n" + block)], kind), "five")
    assert [tuple(r)[2:] for r in index.shared().collect()] == [(5, 2, 2, 2)]


def test_known_blocks_equal_the_members_of_the_whole(spark, index):
    held, arriving = corpus(spark, 1, range(0, 80)), corpus(spark, 2, range(200, 280))
    index.add(held, "held")
    totals = redundancy.block_totals(redundancy.hashed_blocks(held))
    first = {(r.key, r.key2): (r.first_payload, r.first_line, r.payloads) for r in totals.collect()}
    found = redundancy.hashed_blocks(arriving).collect()
    expected = [
        (r.payload_id, r.first_line, r.copies, *first[r.key, r.key2]) for r in found if (r.key, r.key2) in first
    ]
    assert rows(index.known_in(arriving)) == sorted(expected) and expected


def test_a_killed_addition_is_repeated(spark, index, monkeypatch):
    parts = [corpus(spark, n, range(100 * n, 100 * n + 40)) for n in range(3)]
    index.add(parts[0], "a")
    before = rows(index.blocks())

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as killed:
        killed.setattr(BlockIndex, "_commit", die)
        with pytest.raises(RuntimeError):
            index.add(parts[1], "b")
    assert rows(index.blocks()) == before
    assert index.add(parts[2], "c") and index.add(parts[1], "b")
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2])
    assert rows(index.blocks()) == rows(redundancy.block_totals(redundancy.hashed_blocks(whole)))


def test_the_index_is_not_shuffled(spark, index):
    index.add(corpus(spark, 1, range(40)), "a")
    merged = index.merged(corpus(spark, 2, range(100, 140)))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_other_thresholds_are_refused(spark, index):
    index.add(corpus(spark, 1, range(9)), "a")
    with pytest.raises(ValueError, match="other thresholds"):
        BlockIndex(spark, index.path, Thresholds(window_lines=4)).blocks()
