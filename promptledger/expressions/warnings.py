"""Warnings of a payload, as arrays in report order."""

from __future__ import annotations

from promptledger.expressions.base import empty
from promptledger.expressions.secrets import HIGH_ENTROPY, PATTERN_TYPES

WARNING = "STRUCT<severity: STRING, code: STRING, line: INT, message: STRING, hint: STRING>"
SECRET_CODES = tuple(f"SECRET_{t.upper()}" for t in (*PATTERN_TYPES, HIGH_ENTROPY))
CODES = ("DUPLICATE_BLOCK", "LONG_LINE", "CONTEXT_FILL", *SECRET_CODES)


def _warning(severity: str, code: str, line: str, message: str, hint: str) -> str:
    return (
        f"named_struct('severity', '{severity}', 'code', {code}, 'line', CAST({line} AS INT), "
        f"'message', {message}, 'hint', '{hint}')"
    )


def duplicate_warnings(repeats: str) -> str:
    message = (
        "concat('Lines repeat an earlier block (first at line ', d.first_line, "
        "', again at line ', d.repeat_line, ')')"
    )
    hint = "Leave out what is said before to save tokens"
    warning = _warning("warning", "'DUPLICATE_BLOCK'", "d.repeat_line", message, hint)
    return f"transform({repeats}, d -> {warning})"


def long_line_warnings(found: str) -> str:
    message = "concat('Line ', x.line, ' is ', x.bytes, ' bytes long, perhaps pasted data')"
    hint = "Try summarising long data, or leave it out"
    warning = _warning("info", "'LONG_LINE'", "x.line", message, hint)
    return f"transform({found}, x -> {warning})"


def fill_warnings(tokens: str, limit: int) -> str:
    message = f"concat('Context holds ', {tokens}, ' tokens, more than {limit}')"
    hint = "Shorten the text first"
    warning = _warning("warning", "'CONTEXT_FILL'", "NULL", message, hint)
    return f"CASE WHEN {tokens} > {limit} THEN array({warning}) ELSE {empty(WARNING)} END"


def secret_warnings(findings: str) -> str:
    code = "concat('SECRET_', upper(f.type))"
    message = "concat('Possible ', f.type, ' on line ', f.line, ': ', f.match)"
    hint = "Scrub the text first"
    return f"transform({findings}, f -> {_warning('error', code, 'f.line', message, hint)})"


def all_warnings(repeats: str, found: str, tokens: str, findings: str, limit: int) -> str:
    return (
        f"concat({duplicate_warnings(repeats)}, {long_line_warnings(found)}, "
        f"{fill_warnings(tokens, limit)}, {secret_warnings(findings)})"
    )
