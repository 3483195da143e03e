"""Secret and personal-data detection, redaction and entropy.

Patterns run in a fixed order, each on the output of the one before. All matching
is row-local: no shuffle, no Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from promptledger.expressions.base import NEWLINE, empty, let, raw, runs
from promptledger.expressions.text import NON_SPACE, lines

FINDING = (
    "STRUCT<type: STRING, match: STRING, line: INT, redacted: STRING, is_redacted: BOOLEAN>"
)
HIGH_ENTROPY = "high_entropy"
_MARK = "\u0001"
_WORD = "[0-9A-Za-z_]"
_TOKEN = "[A-Za-z0-9_-]"
_LOCAL = r"[A-Za-z0-9._%+\-]"


def _any_case(literal: str) -> str:
    """Match a literal in any case, with the two characters that fold to k and s."""
    extra = {"K": r"\x{212A}", "S": r"\x{17F}"}
    return "".join(
        f"[{c.upper()}{c.lower()}{extra.get(c.upper(), '')}]" if c.isalpha() else c
        for c in literal
    )


# Key prefixes that mark an AWS access key id.
AWS_PREFIXES = ("AKIA", "ASIA", "AROA", "AIDA", "ANPA", "ANVA", "AIPA")
_ALNUM = r"[A-Za-z0-9\x{17F}\x{212A}]"
_PEM_KINDS = ("RSA ", "EC ", "OPENSSH ")
_PEM = f"(?:{'|'.join(_PEM_KINDS)})?PRIVATE KEY-----"


@dataclass(frozen=True)
class Pattern:
    """A detection pattern in Java syntax; ``group`` holds the matched secret.

    ``until``, if given, holds the literal ends of matches.
    """

    type: str
    java: str
    label: str
    group: int = 0
    keep: str = ""
    until: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        return raw(self.java)

    @property
    def replacement(self) -> str:
        return raw(self.keep + self.label)


# Word edges are spelled out as ASCII look-arounds: Java's own \b counts accented
# letters as word characters. \d and \s are ASCII here, and \s has no U+000B. An edge
# ahead of a digit needs no word character before it; ahead of + or ( it needs one.
# A look-ahead for the first character rejects most positions before any alternative.
PATTERNS = (
    Pattern(
        "ssh_key",
        rf"-----BEGIN {_PEM}[\s\S]*?-----END {_PEM}",
        "[REDACTED:SSH_PRIVATE_KEY]",
        until=tuple(f"-----END {kind}PRIVATE KEY-----" for kind in (*_PEM_KINDS, "")),
    ),
    # All starts in one run of token characters share its end, so only the first can
    # match. Anchoring at the run and holding on to its first start keeps runs linear.
    Pattern(
        "jwt",
        rf"(?<!{_TOKEN})(?>({_TOKEN}*?)(?=eyJ))(eyJ{_TOKEN}{{10,}}+\.eyJ{_TOKEN}{{10,}}+\.{_TOKEN}{{10,}}+)",
        "[REDACTED:JWT]",
        group=2,
        keep="$1",
    ),
    Pattern(
        "aws_credential",
        rf"(?=[Aa])(?:{'|'.join(map(_any_case, AWS_PREFIXES))}){_ALNUM}{{16}}",
        "[REDACTED:AWS_KEY]",
    ),
    Pattern(
        "api_key",
        rf"(?=[AaSs\x{{17F}}])(?:{_any_case('sk-')}{_ALNUM}{{20,}}"
        rf"|{_any_case('ant')}[A-Za-z0-9_\x{{17F}}\x{{212A}}-]{{30,}}"
        rf"|{_any_case('api')}[_-]?{_any_case('key')}"
        r"[\t\n\f\r ]*[:=][\t\n\f\r ]*[^\t\n\f\r ]{16,})",
        "[REDACTED:API_KEY]",
    ),
    # An address starts at the first word edge of a run of local-part characters, or
    # right behind the address before it. Finding the run start by look-behind keeps
    # long runs without an @ linear; symbols ahead of the edge are group 1 and stay.
    Pattern(
        "email",
        rf"(?:(?<=[A-Za-z])\G|(?<!{_LOCAL})([.%+\-]*+)(?={_WORD}))"
        rf"({_LOCAL}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}(?!{_WORD}))",
        "[REDACTED:EMAIL]",
        group=2,
        keep="$1",
    ),
    Pattern(
        "ssn",
        rf"[0-9](?<!{_WORD}[0-9])[0-9]{{2}}[-\t\n\f\r ]?[0-9]{{2}}[-\t\n\f\r ]?[0-9]{{4}}(?!{_WORD})",
        "[REDACTED:SSN]",
    ),
    Pattern(
        "phone",
        rf"(?=[0-9+(])(?:(?=[0-9])(?<!{_WORD})|(?=[+(])(?<={_WORD}))(?:\+?1[-.\t\n\f\r ]?)?"
        r"\(?[0-9]{3}\)?[-.\t\n\f\r ]?[0-9]{3}"
        rf"[-.\t\n\f\r ]?[0-9]{{4}}(?!{_WORD})",
        "[REDACTED:PHONE]",
    ),
)
PATTERN_TYPES = tuple(p.type for p in PATTERNS)

# A text without the marker cannot match; a plain search is cheaper than the pattern.
_MARKERS = {"ssh_key": "PRIVATE KEY-----", "jwt": "eyJ", "email": "@"}


def chosen(types: Iterable[str] | None) -> list[Pattern]:
    """The patterns of the given types, all by default, in their fixed order."""
    wanted = set(PATTERN_TYPES if types is None else types)
    unknown = wanted - set(PATTERN_TYPES)
    if unknown:
        raise ValueError(f"unknown finding types: {sorted(unknown)}")
    return [p for p in PATTERNS if p.type in wanted]


def scope(text: str, p: Pattern) -> str:
    """The beginning of the text behind which no match starts. Without it every opening
    mark that is never closed would be followed to the end of the text.

    It ends with the last end of a match; what lies behind is found by plain search, as a
    pattern would read the text to its end and go back.
    """
    if not p.until:
        return text
    ends = ", ".join(f"length(sc) - length(substring_index(sc, {raw(end)}, -1))" for end in p.until)
    return let("sc", text, f"left(sc, greatest({ends}))")


def hit(text: str, p: Pattern) -> str:
    """Whether a pattern matches anywhere in the text."""
    found = f"rlike({scope(text, p)}, {p.pattern})"
    marker = _MARKERS.get(p.type)
    return f"(contains({text}, '{marker}') AND {found})" if marker else found


def replaced(text: str, p: Pattern) -> str:
    if not p.until:
        return f"regexp_replace({text}, {p.pattern}, {p.replacement})"
    head = f"regexp_replace(hd, {p.pattern}, {p.replacement})"
    return let("hd", scope(text, p), f"concat({head}, substring({text}, length(hd) + 1))")


def redact(text: str, types: Iterable[str] | None = None) -> str:
    """Text with every match of the chosen patterns replaced by its label."""
    for p in chosen(types):
        text = let("t", text, f"CASE WHEN {hit('t', p)} THEN {replaced('t', p)} ELSE t END")
    return text


def shown(match: str) -> str:
    """Long matches are cut to their first 20 and last 8 characters for display."""
    return (
        f"CASE WHEN octet_length({match}) > 40 "
        f"THEN concat(substring({match}, 1, 20), '...', right({match}, 8)) ELSE {match} END"
    )


def _breaks(text: str) -> str:
    return f"regexp_replace({text}, {raw('[^' + chr(10) + ']+')}, '')"


def match_lines(text: str, matches: str, pattern: str) -> str:
    """1-based line of each match, in match order.

    Rebuilds the text with nothing left but newlines and one mark per match, so a
    single pass over its lines numbers all matches; cost is linear in the text.
    """
    mark = (
        f"CASE WHEN k < size({matches}) "
        f"THEN concat('{_MARK}', {_breaks(f'get({matches}, k)')}) ELSE '' END"
    )
    skeleton = (
        f"array_join(transform(split({text}, {pattern}, -1), "
        f"(piece, k) -> concat({_breaks('piece')}, {mark})), '')"
    )
    return (
        f"flatten(transform(split({skeleton}, {NEWLINE}, -1), "
        "(marks, i) -> array_repeat(i + 1, length(marks))))"
    )


def _finding(kind: str, match: str, line: str, label: str, done: bool) -> str:
    return (
        f"named_struct('type', '{kind}', 'match', {match}, 'line', {line}, "
        f"'redacted', '{label}', 'is_redacted', {str(done).lower()})"
    )


def pattern_findings(text: str, p: Pattern) -> str:
    """All matches of one pattern in ``text``; the line is that of ``text`` itself."""
    each = _finding(p.type, shown("m"), "get(at, k)", p.label, True)
    numbered = let("at", match_lines("hd", "ms", p.pattern), f"transform(ms, (m, k) -> {each})")
    matches = f"regexp_extract_all(hd, {p.pattern}, {p.group})"
    return let("hd", scope(text, p), let("ms", matches, numbered))


def shannon_entropy(word: str) -> str:
    """Bits per character, rounded to 9 places; 0 for the empty string.

    The characters are sorted and their runs counted, whatever the alphabet.
    """
    letters = "sort_array(filter(split(wd, ''), c -> c <> ''))"
    counts = f"transform({let('o', letters, runs('o', '(a = b)'))}, g -> size(g))"
    bits = (
        f"aggregate({counts}, 0.0D, (n, x) -> n - x / length(wd) * log2(x / length(wd)))"
    )
    return let("wd", word, f"CASE WHEN length(wd) = 0 THEN 0.0D ELSE round({bits}, 9) END")


def high_entropy_findings(clean: str, threshold: float = 4.5) -> str:
    """Random-looking words of at least 20 bytes; reported, not redacted.

    Entropy is at most log2 of the length, so words shorter than 2^threshold characters
    cannot qualify and are never cut out of the text. Pieces between blanks that are too
    short hold no such word, so only the long ones are searched.
    """
    threshold = threshold if threshold > 0 else 4.5
    fewest = max(5, math.ceil(2 ** min(threshold, 16) - 1e-6))
    long_word = raw(f"{NON_SPACE}{{{fewest},}}")
    suspicious = (
        "octet_length(w) >= 20 AND NOT startswith(w, '[REDACTED') "
        f"AND {shannon_entropy('w')} >= {float(threshold)!r}D"
    )
    each = _finding(HIGH_ENTROPY, "concat(substring(w, 1, 12), '...')", "i + 1", "", False)
    pieces = f"filter(split(ln, ' ', -1), pc -> octet_length(pc) >= {fewest})"
    words = f"flatten(transform({pieces}, pc -> regexp_extract_all(pc, {long_word}, 0)))"
    in_line = f"transform(filter({words}, w -> {suspicious}), w -> {each})"
    long_enough = f"CASE WHEN octet_length(ln) >= {fewest} THEN {in_line} ELSE {empty(FINDING)} END"
    return (
        f"CASE WHEN octet_length({clean}) >= {fewest} "
        f"THEN flatten(transform({lines(clean)}, (ln, i) -> {long_enough})) "
        f"ELSE {empty(FINDING)} END"
    )


def scrub(
    text: str, types: Iterable[str] | None = None, entropy_threshold: float = 4.5
) -> str:
    """``struct(clean, findings, has_secrets)``; each pattern scans the text once."""
    state = f"named_struct('clean', {text}, 'findings', {empty(FINDING)})"
    for p in chosen(types):
        changed = (
            f"named_struct('clean', {replaced('s.clean', p)}, "
            f"'findings', concat(s.findings, {pattern_findings('s.clean', p)}))"
        )
        state = let("s", state, f"CASE WHEN {hit('s.clean', p)} THEN {changed} ELSE s END")
    every = f"concat(s.findings, {high_entropy_findings('s.clean', entropy_threshold)})"
    result = "named_struct('clean', s.clean, 'findings', f, 'has_secrets', size(f) > 0)"
    return let("s", state, let("f", every, result))
