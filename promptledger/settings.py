"""Operator parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_MODEL = "claude-sonnet-4-5"


@dataclass(frozen=True)
class Thresholds:
    """Limits that decide when an operator warns, blocks or stops."""

    daily_limit: float = 10.00
    session_limit: float = 2.00
    warn_percent: int = 80
    hard_stop: bool = False
    entropy: float = 4.5
    long_line_bytes: int = 500
    context_tokens: int = 60_000
    hint_tokens: int = 1000
    window_lines: int = 5
    window_min_words: int = 10
    symbol_share: float = 0.20


DEFAULTS = Thresholds()
