"""Repeated blocks of lines inside one payload."""

from __future__ import annotations

from promptledger.expressions.base import NEWLINE, empty, let, raw, runs
from promptledger.expressions.text import SPACE_CHARS, lines, lower_each, text_size, trim_space

BLOCK = "STRUCT<key: BIGINT, key2: BIGINT, i: INT>"
HASHES = "STRUCT<key: BIGINT, key2: BIGINT>"
REPEAT = "STRUCT<first_line: INT, repeat_line: INT>"
LONG_LINE = "STRUCT<line: INT, bytes: BIGINT>"
SAME_KEY = "(a.key = b.key AND a.key2 = b.key2)"


def line_windows(text: str, size: int, min_words: int) -> str:
    """Hashed sliding windows of ``size`` lines with at least ``min_words`` words.

    Array of ``struct(key, key2, i)``: two independent 64-bit hashes of the trimmed,
    lowercased window and its 0-based first line. White space never joins words
    across lines, so window word counts are sums of line word counts, and only windows
    that qualify are put together and hashed.
    """
    words = f"aggregate(slice(wc, wi + 1, {size}), 0L, (x, y) -> x + y)"
    content = trim_space(f"array_join(slice(ls, wi + 1, {size}), {NEWLINE})")
    hashed = let(
        "wt",
        content,
        "named_struct('key', xxhash64(wt), 'key2', xxhash64('second', wt), 'i', wi)",
    )
    windows = (
        f"filter(transform(sequence(0, size(ls) - {size}), wi -> "
        f"CASE WHEN {words} >= {min_words} THEN {hashed} END), w -> w IS NOT NULL)"
    )
    counts = f"transform(ls, ln -> {text_size('ln')}.words)"
    body = (
        f"CASE WHEN size(ls) >= {size} THEN {let('wc', counts, windows)} "
        f"ELSE {empty(BLOCK)} END"
    )
    return let("ls", lines(lower_each(text)), body)


def block_groups(windows: str) -> str:
    """Windows of one payload grouped by key: arrays in line order, one per key."""
    return let("o", f"sort_array({windows})", runs("o", SAME_KEY))


def payload_blocks(text: str, size: int, min_words: int) -> str:
    """One ``struct(key, key2, first_line, copies)`` per distinct window of a payload."""
    block = (
        "named_struct('key', g[0].key, 'key2', g[0].key2, 'first_line', g[0].i + 1, "
        "'copies', CAST(size(g) AS BIGINT))"
    )
    return f"transform({block_groups(line_windows(text, size, min_words))}, g -> {block})"


def duplicate_blocks(text: str, size: int, min_words: int, min_gap: int = 1) -> str:
    """Repeats of an earlier window: ``struct(first_line, repeat_line)``, 1-based.

    Sorting the hashed windows brings equal ones together, so the cost is n log n in
    the payload's lines. ``min_gap`` sets how many lines must lie between the starts;
    the default keeps overlapping repeats.
    """
    repeats = (
        f"transform(filter(slice(g, 2, size(g)), w -> w.i - g[0].i >= {min_gap}), "
        "w -> named_struct('repeat_line', w.i + 1, 'first_line', g[0].i + 1))"
    )
    several = f"filter({block_groups('ws')}, g -> size(g) > 1)"
    in_order = (
        f"transform(sort_array(flatten(transform({several}, g -> {repeats}))), "
        "r -> named_struct('first_line', r.first_line, 'repeat_line', r.repeat_line))"
    )
    body = (
        "CASE WHEN size(array_distinct(transform(ws, w -> w.key))) < size(ws) "
        f"THEN {in_order} ELSE {empty(REPEAT)} END"
    )
    return let("ws", line_windows(text, size, min_words), body)


def hashed_line(line: str) -> str:
    """What a window needs of a line: its words, and 128-bit hashes of the line as it is and
    trimmed on either side and on both."""

    def pair(text: str) -> str:
        return f"named_struct('key', xxhash64({text}), 'key2', xxhash64('second', {text}))"

    chars = raw(SPACE_CHARS)
    return let(
        "lw",
        line,
        f"named_struct('words', {text_size('lw')}.words, 'as_is', {pair('lw')}, "
        f"'first', {pair(f'trim(LEADING {chars} FROM lw)')}, "
        f"'last', {pair(f'trim(TRAILING {chars} FROM lw)')}, 'only', {pair(trim_space('lw'))})",
    )


def window_of_lines(hashed: str) -> str:
    """``struct(key, key2)`` of a window of hashed lines (a name), equal for windows whose
    trimmed texts are equal."""
    worded = (
        f"filter(transform({hashed}, (hl, hi) -> CASE WHEN hl.words > 0 THEN hi END), "
        "hi -> hi IS NOT NULL)"
    )
    several = (
        f"concat(array({hashed}[nb[0]].first), "
        f"transform(slice({hashed}, nb[0] + 2, element_at(nb, -1) - nb[0] - 1), hl -> hl.as_is), "
        f"array({hashed}[element_at(nb, -1)].last))"
    )
    content = (
        f"CASE WHEN size(nb) = 0 THEN {empty(HASHES)} "
        f"WHEN nb[0] = element_at(nb, -1) THEN array({hashed}[nb[0]].only) "
        f"ELSE {several} END"
    )
    keys = (
        "named_struct('key', xxhash64(transform(hc, hp -> hp.key)), "
        "'key2', xxhash64('second', transform(hc, hp -> hp.key2)))"
    )
    return let("nb", worded, let("hc", content, keys))


def long_lines(text: str, limit: int) -> str:
    """Lines of more than ``limit`` bytes: ``struct(line, bytes)``, 1-based."""
    sized = (
        f"transform({lines(text)}, (ln, i) -> named_struct('line', i + 1, "
        "'bytes', CAST(octet_length(ln) AS BIGINT)))"
    )
    return (
        f"CASE WHEN octet_length({text}) > {limit} "
        f"THEN filter({sized}, x -> x.bytes > {limit}) ELSE {empty(LONG_LINE)} END"
    )


def compact_text(text: str, size: int, min_words: int) -> str:
    """Text without the lines of later duplicate windows.

    Only windows that start at least ``size`` lines behind their first copy are
    dropped, so an original is never removed together with its repeat. Walking the
    sorted starts, each kept stretch runs from the end of what is dropped so far to the
    next dropped window.
    """
    edges = (
        f"concat(array(-{size}), transform(rp, r -> r.repeat_line - 1), array(size(ls)))"
    )
    stretch = (
        f"CASE WHEN get(e, j + 1) > s + {size} THEN "
        f"slice(ls, s + {size} + 1, get(e, j + 1) - s - {size}) ELSE {empty('STRING')} END"
    )
    kept = f"flatten(transform(slice(e, 1, size(e) - 1), (s, j) -> {stretch}))"
    rebuilt = let("ls", lines("tx"), let("e", edges, f"array_join({kept}, {NEWLINE})"))
    repeats = duplicate_blocks("tx", size, min_words, size)
    return let(
        "tx", text, let("rp", repeats, f"CASE WHEN size(rp) > 0 THEN {rebuilt} ELSE tx END")
    )
