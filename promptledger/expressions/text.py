"""Size, shape and formatting measures of a text."""

from __future__ import annotations

from promptledger.expressions.base import NEWLINE, let, raw

# Unicode White_Space as a regular expression. The flag makes the predefined classes
# Unicode-aware; spelling the ranges out in a class of our own is 30 times slower.
SPACES = raw(r"(?U)\s+")
NON_SPACE = r"(?U)\S"

# The Unicode White_Space characters.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: str) -> str:
    """Strip Unicode white space from both ends (built-in trim strips U+0020 only)."""
    return f"btrim({text}, {raw(SPACE_CHARS)})"


def lower_each(text: str) -> str:
    """Lowercase character by character, without the two context-dependent cases."""
    return f"lower(replace(replace({text}, 'İ', 'i'), 'Σ', 'σ'))"


def lines(text: str) -> str:
    """The lines of a text; a trailing newline opens one more, empty line."""
    return f"split({text}, {NEWLINE}, -1)"


def single_spaced(text: str) -> str:
    return f"regexp_replace({text}, {SPACES}, ' ')"


def bare(spaced: str) -> str:
    """Single-spaced text without its spaces."""
    return f"replace({spaced}, ' ', '')"


def words_of(spaced: str) -> str:
    """Words of a single-spaced text."""
    return (
        f"CAST(CASE WHEN length(btrim({spaced})) > 0 "
        f"THEN length(btrim({spaced})) - length({bare(spaced)}) + 1 ELSE 0 END AS BIGINT)"
    )


def tokens_from(non_space: str, words: str) -> str:
    """About four characters a token, and at least one token a word."""
    return f"CAST(greatest(ceil({non_space} / 4), {words}) AS BIGINT)"


def non_space_length(text: str) -> str:
    return f"CAST(length({bare(single_spaced(text))}) AS BIGINT)"


def word_count(text: str) -> str:
    return words_of(single_spaced(text))


def token_count(text: str) -> str:
    """Estimated tokens of the whole text; the estimate is not additive over parts.

    The spaces are replaced once, also in lambdas and filters, where nothing shares
    subexpressions.
    """
    return let("sp", single_spaced(text), tokens_from(f"length({bare('sp')})", words_of("sp")))


def text_size(text: str) -> str:
    """``struct(non_space, words)``: the additive parts of the token estimate."""
    size = (
        f"named_struct('non_space', CAST(length({bare('sp')}) AS BIGINT), "
        f"'words', {words_of('sp')})"
    )
    return let("sp", single_spaced(text), size)


def line_count(text: str) -> str:
    newlines = f"length({text}) - length(replace({text}, {NEWLINE}, ''))"
    return f"CAST(CASE WHEN length({text}) = 0 THEN 0 ELSE {newlines} + 1 END AS BIGINT)"


def projected_output(tokens: str) -> str:
    """Output is assumed to be a quarter of the input, rounded up."""
    return f"CAST(ceil({tokens} * 0.25D) AS BIGINT)"


def symbol_share(text: str) -> str:
    """Share of symbols (neither letter nor digit) among non-space characters."""
    content = bare(single_spaced(text))
    letters = raw(r"[\p{L}\p{Nd}]+")
    return (
        f"CASE WHEN length({content}) > 0 THEN "
        f"length(regexp_replace({content}, {letters}, '')) / length({content}) ELSE 0.0D END"
    )


def fixed(value: str, digits: int) -> str:
    """Print a double with ``digits`` decimals, rounded by its exact binary value.

    Java formatting rounds the shortest decimal form half up, so values such as
    0.00145 differ from the correctly rounded text. The product with the power of ten
    is split in a rounded part and its exact error, which settles near-ties.
    """
    scale = f"{10**digits}D"
    a = f"abs({value})"
    product = f"({a} * {scale})"
    whole = f"CAST(floor({product}) AS DOUBLE)"
    high = f"({a} * 134217729D - ({a} * 134217729D - {a}))"
    error = f"(({high} * {scale} - {product}) + ({a} - {high}) * {scale})"
    side = f"(({product} - {whole}) - 0.5D)"
    up = (
        f"({side} > 0 OR ({side} = 0 AND ({error} > 0 "
        f"OR ({error} = 0 AND {whole} % 2 = 1))))"
    )
    units = f"(CAST({whole} AS BIGINT) + CASE WHEN {up} THEN 1 ELSE 0 END)"
    base = f"{10**digits}L"
    return (
        f"concat(CASE WHEN {value} < 0 THEN '-' ELSE '' END, {units} DIV {base}, '.', "
        f"lpad(CAST({units} % {base} AS STRING), {digits}, '0'))"
    )


def format_cost(usd: str) -> str:
    """Dollar text with more decimals for smaller amounts."""
    return (
        f"CASE WHEN {usd} = 0 THEN '$0.00' WHEN {usd} < 0.001 THEN '<$0.001' "
        f"WHEN {usd} < 0.01 THEN concat('$', {fixed(usd, 4)}) "
        f"WHEN {usd} < 1.0 THEN concat('$', {fixed(usd, 3)}) "
        f"ELSE concat('$', {fixed(usd, 2)}) END"
    )


def format_tokens(n: str) -> str:
    """Thousands separators from 1,000 on; smaller and negative counts stay plain."""
    return f"CASE WHEN {n} < 1000 THEN CAST({n} AS STRING) ELSE format_number({n}, 0) END"


def shortening_hint(tokens: str, above: int = 1000) -> str:
    """Hint for payloads worth shortening; empty below the limit."""
    return (
        f"CASE WHEN {tokens} > {above} THEN concat('Compress to save about ', "
        f"{tokens} DIV 4, ' tokens before sending') ELSE '' END"
    )
