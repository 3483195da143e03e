"""Stable and dynamic sections of a prompt.

Within one payload all steps are row-local and linear in its lines. Conversations
whose lines are spread over many rows go through ``operators.conversations``.
"""

from __future__ import annotations

from promptledger.expressions.base import NEWLINE, empty, let, raw
from promptledger.expressions.text import (
    format_cost,
    lines,
    lower_each,
    token_count,
    trim_space,
)

STABLE = "stable"
DYNAMIC = "dynamic"

# Keywords that mark a line, matched as lowercase substrings.
STABLE_KEYWORDS = (
    "you are",
    "your role",
    "always",
    "never",
    "important:",
    "instructions:",
    "system:",
    "assistant:",
    "rules:",
    "guidelines:",
    "context:",
    "## system",
    "# system",
    "<system>",
    "</system>",
)
DYNAMIC_KEYWORDS = (
    "user:",
    "human:",
    "question:",
    "request:",
    "<user>",
    "</user>",
    "please help",
    "can you",
    "i need",
    "i want",
)

# USD per million tokens that caching saves, and the advice given.
SAVED_ANTHROPIC = 3.00 - 0.30
SAVED_OPENAI = 2.50 - 1.25
ADVICE_REORDER = (
    "Move stable content (system prompt, instructions) before dynamic content "
    "(user input) to maximise cache hits"
)
ADVICE_EXTRACT = (
    "Consider extracting more instructions to a static system prompt to increase "
    "cache hit rate"
)

MARK = "STRUCT<i: INT, label: STRING>"


def has_any(lowered: str, keywords: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {raw(k)})" for k in keywords) + ")"


def line_mark(lowered: str) -> str:
    """Label a lowercased line by its own keywords; null when it has none."""
    return (
        f"CASE WHEN {has_any(lowered, DYNAMIC_KEYWORDS)} THEN '{DYNAMIC}' "
        f"WHEN {has_any(lowered, STABLE_KEYWORDS)} THEN '{STABLE}' END"
    )


def label_changes(text: str) -> str:
    """Lines (0-based) at which the label flips, as ``struct(i, label)``.

    A text starts out stable, and a line without keywords carries the label on. Every
    flip needs a dynamic keyword somewhere, so other texts are not split at all.
    """
    marks = (
        f"filter(transform({lines('low')}, (ln, i) -> "
        f"named_struct('i', i, 'label', {line_mark('ln')})), m -> m.label IS NOT NULL)"
    )
    flips = (
        f"filter(transform(mk, (m, j) -> CASE WHEN m.label <> "
        f"coalesce(get(mk, j - 1).label, '{STABLE}') THEN m END), m -> m IS NOT NULL)"
    )
    body = (
        f"CASE WHEN {has_any('low', DYNAMIC_KEYWORDS)} THEN {let('mk', marks, flips)} "
        f"ELSE {empty(MARK)} END"
    )
    return let("low", lower_each(text), body)


def _over_bounds(text: str, body: str) -> str:
    """Bind the lines as ``ls`` and the section bounds as ``bd`` for ``body``."""
    start = f"array(named_struct('i', 0, 'label', '{STABLE}'))"
    bounds = f"concat({start}, {label_changes('tx')})"
    return let("tx", text, let("ls", lines("tx"), let("bd", bounds, body)))


_END = "coalesce(get(bd, j + 1).i, size(ls))"


def line_labels(text: str) -> str:
    """Every line with its label: ``struct(line, type, content)`` in line order."""
    labelled = (
        "named_struct('line', s.i + k + 1, 'type', s.label, 'content', ln)"
    )
    stretch = f"transform(slice(ls, s.i + 1, {_END} - s.i), (ln, k) -> {labelled})"
    return _over_bounds(text, f"flatten(transform(bd, (s, j) -> {stretch}))")


def sections(text: str) -> str:
    """Runs of equally labelled lines; a leading blank-only section is left out."""
    section = let(
        "sc",
        f"array_join(slice(ls, s.i + 1, {_END} - s.i), {NEWLINE})",
        "named_struct('type', s.label, 'content', sc, 'line_start', s.i + 1, "
        f"'line_end', {_END}, 'tokens', {token_count('sc')})",
    )
    return _over_bounds(
        text,
        f"filter(transform(bd, (s, j) -> {section}), x -> {trim_space('x.content')} <> '')",
    )


def tokens_of(found: str, kind: str) -> str:
    """Summed tokens of the sections of one type."""
    return f"aggregate(filter({found}, s -> s.type = '{kind}'), 0L, (n, s) -> n + s.tokens)"


def reorder_needed(found: str) -> str:
    """True when a dynamic section comes before a stable one.

    Sections alternate, so that is so whenever there are three, or two of which the
    first is dynamic.
    """
    return (
        f"(size({found}) > 2 OR "
        f"(size({found}) = 2 AND get({found}, 0).type = '{DYNAMIC}'))"
    )


def saved(tokens: str, per_million: float) -> str:
    return f"({tokens} * {per_million!r}D / 1000000)"


def recommendations(stable: str, dynamic: str, reorder: str) -> str:
    """Up to three texts in a fixed order."""
    first, second = saved(stable, SAVED_ANTHROPIC), saved(stable, SAVED_OPENAI)
    cache = (
        f"concat('Cache the ', {stable}, ' stable tokens to save ~', {format_cost(first)}, "
        f"' per request (Anthropic) or ~', {format_cost(second)}, ' (OpenAI)')"
    )
    return (
        f"array_compact(array(CASE WHEN {reorder} THEN '{ADVICE_REORDER}' END, "
        f"CASE WHEN {stable} > 0 THEN {cache} END, "
        f"CASE WHEN {dynamic} > {stable} AND {stable} > 0 THEN '{ADVICE_EXTRACT}' END))"
    )
