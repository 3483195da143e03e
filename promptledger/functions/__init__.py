"""Column functions.

Arguments are column names or SQL expressions; each function returns a Column, e.g.
``df.select(token_count("text"), scrub("text")["clean"])``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptledger.expressions import blocks, linediff, secrets, sections, text, warnings


def _column(build: Callable[..., str]) -> Callable[..., Column]:
    @wraps(build)
    def column(*args, **kwargs) -> Column:
        return F.expr(build(*args, **kwargs))

    return column


token_count = _column(text.token_count)
word_count = _column(text.word_count)
line_count = _column(text.line_count)
non_space_length = _column(text.non_space_length)
projected_output = _column(text.projected_output)
symbol_share = _column(text.symbol_share)
tokens_from = _column(text.tokens_from)
fixed = _column(text.fixed)
format_cost = _column(text.format_cost)
format_tokens = _column(text.format_tokens)
shortening_hint = _column(text.shortening_hint)

redact = _column(secrets.redact)
scrub = _column(secrets.scrub)
shannon_entropy = _column(secrets.shannon_entropy)
high_entropy_findings = _column(secrets.high_entropy_findings)

payload_blocks = _column(blocks.payload_blocks)
duplicate_blocks = _column(blocks.duplicate_blocks)
long_lines = _column(blocks.long_lines)
window_of_lines = _column(blocks.window_of_lines)
compact_text = _column(blocks.compact_text)
all_warnings = _column(warnings.all_warnings)

line_labels = _column(sections.line_labels)
section_list = _column(sections.sections)
tokens_of = _column(sections.tokens_of)
reorder_needed = _column(sections.reorder_needed)
saved = _column(sections.saved)
recommendations = _column(sections.recommendations)

lines_only_in = _column(linediff.lines_only_in)
lines_in_both = _column(linediff.lines_in_both)
