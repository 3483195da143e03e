"""Line comparison of two texts as multisets, row-local."""

from __future__ import annotations

from promptledger.expressions.base import empty, let, runs
from promptledger.expressions.text import lines


def numbered_lines(text: str) -> str:
    """Lines with the number of their copy, so that equal lines stay apart.

    The number goes in front, with a separator, to make each element one string: the
    set functions hash strings but compare structs pair by pair.
    """
    numbered = "flatten(transform(rn, g -> transform(g, (ln, k) -> concat(k + 1, ':', ln))))"
    return let(
        "o",
        f"sort_array({lines(text)})",
        let("rn", runs("o", "(a = b)"), numbered),
    )


def split_numbers(numbered: str) -> str:
    """``struct(copy, line)`` for each numbered line."""
    return (
        f"transform({numbered}, x -> named_struct("
        "'copy', CAST(substring_index(x, ':', 1) AS BIGINT), "
        "'line', substring(x, instr(x, ':') + 1)))"
    )


def lines_only_in(left: str, right: str) -> str:
    """``struct(copy, line)`` of the lines of ``left`` without a partner in ``right``."""
    unmatched = f"array_except({numbered_lines(left)}, {numbered_lines(right)})"
    return split_numbers(
        f"CASE WHEN {left} = {right} THEN {empty('STRING')} ELSE {unmatched} END"
    )


def lines_in_both(left: str, right: str) -> str:
    """``struct(copy, line)`` of the lines that have a partner on the other side."""
    return split_numbers(f"array_intersect({numbered_lines(left)}, {numbered_lines(right)})")
