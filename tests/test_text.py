import decimal
import random

from promptledger import functions as fn
from tests.plain_models import SPACE, fields, tokens

LONG = (
    "The quick brown fox jumps over the lazy dog. "
    "This is a longer paragraph with more words."
)


def test_token_ranges(value_of):
    cases = [("", 0, 0), ("hello", 1, 2), ("four words in text", 4, 6), (LONG, 18, 30)]
    counts = value_of([c[0] for c in cases], fn.token_count("x"))
    assert all(low <= n <= high for n, (_, low, high) in zip(counts, cases))


def test_tokens_take_the_whole_text_not_the_word(value_of):
    assert value_of(["a b abcdefgh", "a b c"], fn.token_count("x")) == [3, 3]


def test_counts_match_a_plain_model(value_of):
    rng = random.Random(7)
    alphabet = "abé漢😀" + SPACE
    values = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(500)]
    assert value_of(values, fn.token_count("x")) == [tokens(v) for v in values]
    assert value_of(values, fn.word_count("x")) == [len(fields(v)) for v in values]


def test_words_and_lines(value_of):
    assert value_of(["  spaces  around  ", "", " "], fn.word_count("x")) == [2, 0, 0]
    assert value_of(["", "one", "a\nb", "a\n"], fn.line_count("x")) == [0, 1, 2, 2]


def test_projected_output(value_of):
    assert value_of([100, 1000, 0, 1], fn.projected_output("x"), "BIGINT") == [25, 250, 0, 1]


def test_code_share(value_of):
    go = 'func main() { fmt.Println("x"); if a != b { return &c[0] } }'
    shares = value_of(["", "  \n", "This is normal English prose.", go], fn.symbol_share("x"))
    assert [s > 0.20 for s in shares] == [False, False, False, True]


def test_cost_format(value_of):
    cases = {0.0: "$0.00", 0.00001: "<$0.001", 0.0035: "$0.0035", 0.043: "$0.043", 1.5: "$1.50"}
    cases |= {-1.0: "<$0.001", 0.125: "$0.125", 2.675: "$2.67", 1e6: "$1000000.00"}
    assert value_of(list(cases), fn.format_cost("x"), "DOUBLE") == list(cases.values())


def test_fixed_rounds_the_exact_binary_value(value_of):
    rng = random.Random(3)
    values = [rng.randrange(10**7) * 3 / 1e6 for _ in range(3000)]
    values += [n / 2000 for n in range(500)] + [n / 1024 for n in range(500)]

    def exact(v, digits):
        step = decimal.Decimal(1).scaleb(-digits)
        return str(decimal.Decimal(v).quantize(step, decimal.ROUND_HALF_EVEN))

    for digits in (2, 3, 4, 6):
        assert value_of(values, fn.fixed("x", digits), "DOUBLE") == [
            exact(v, digits) for v in values
        ]


def test_token_format(value_of):
    cases = {0: "0", 999: "999", 1000: "1,000", 1234567: "1,234,567", -5000: "-5000"}
    assert value_of(list(cases), fn.format_tokens("x"), "BIGINT") == list(cases.values())


def test_hint(value_of):
    hints = value_of([1000, 1001], fn.shortening_hint("x"), "BIGINT")
    assert hints == ["", "Compress to save about 250 tokens before sending"]
