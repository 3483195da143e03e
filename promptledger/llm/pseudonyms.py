"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

Numbers and dates are found by pattern, validated, and permuted within their format by a
keyed Feistel network: the value is two digits (a, b) to mixed bases (A, B), and eight
rounds add a keyed hash of one to the other. A permutation keeps different values apart;
equal values get equal pseudonyms in every document. Check digits are computed anew.

==========  =======================================================  =====================
kind        valid if                                                 kept
==========  =======================================================  =====================
card        13 to 19 digits, plain or in groups, Luhn sum is 0       grouping, Luhn
ssn         area not 000, 666, 9xx; group, serial not 0              form, validity
iban        15 to 34 characters, plain or in groups of four,         country, letters, grouping
            remainder by 97 is 1
phone       (123) 456-7890 and the like, country code or not;        code, form
            + and country code, digits in any groups
ipv4        four numbers up to 255                                   form
date        a day of 1800 to 2199: 2020-01-31, 2020/01/31,           form
            31.01.2020, 01/31/2020
==========  =======================================================  =====================

E-mail addresses and secrets of 32 and more hexadecimal digits have no numeric domain; they
become keyed hashes (an address in ``.invalid``, hexadecimal digits in the same case and
number). What fails validation stays as it is.

Result: all rows and columns, the text with pseudonyms, and ``n_values``, how many were
replaced. A null text stays null with 0 values, an empty text stays empty. Repeated rows get
equal results. A column that is already named ``n_values`` is replaced. An empty table gives
an empty result. One narrow step: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR = "(?:18|19|20|21)[0-9]{2}"
_MONTH = "(?:0[1-9]|1[0-2])"
_DAY = "(?:0[1-9]|[12][0-9]|3[01])"
_DATE = rf"(?:{_YEAR}-{_MONTH}-{_DAY}|{_YEAR}/{_MONTH}/{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_MONTH}/{_DAY}/{_YEAR})"
#: Country codes of telephone numbers.
_CODE = (
    "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    "|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[057-9]|9[679])[0-9])"
)
_OTHER = (
    rf"(?:{_DATE}|(?:{_OCTET}\.){{3}}{_OCTET}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}"
    r"|(?:[0-9]{4}[ \-]){3}[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9]|\.[0-9])"
)
#: Behind the plus: plain, grouped by blanks and hyphens, or by dots.
_ABROAD = (
    rf"\+(?![0-9]{{1,3}}[ .\-]{_OTHER}){_CODE}(?:[0-9]{{8,12}}"
    r"|(?:[ \-](?:\([0-9]{1,4}\)[ \-]?)?|\([0-9]{1,4}\)[ \-]?)[0-9](?:[ \-]?[0-9]){5,11}"
    r"|(?=\.(?:[0-9]\.?){7})(?:\.[0-9]{1,5}){3,5})"
)
#: Alternatives in the order they are tried at a position; those of IBAN are the valid ones of
#: the text, as only the remainder tells where a grouped one ends.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.){1,127}[A-Za-z]{2,}",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9./\-]){_DATE}(?![0-9]|[./\-][0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "phone": (
        r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
        rf"|{_ABROAD})(?![0-9]|-[0-9])"
    ),
    "card": (
        r"(?<![0-9A-Za-z])(?:[0-9]{13,19}+|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}"
        r"|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"
    ),
}
BEFORE_IBAN = "|".join(PATTERNS[kind] for kind in ("email", "hex"))
AFTER_IBAN = "|".join(PATTERNS[kind] for kind in ("ipv4", "date", "ssn", "phone", "card"))
#: Candidates may overlap.
IBAN_AHEAD = f"(?=({PATTERNS['iban']}))"
#: Every kind has one of these.
HINT = r"@|[0-9]{2}|[0-9][.][0-9]|[0-9A-Fa-f]{32}"

FIRST_DAY = "1800-01-01"
#: The days of 400 years are DAY_BASES[0] * DAY_BASES[1].
DAY_BASES = (189, 773)


def digest(key: str, kind: str, *parts: Column) -> Column:
    """Hexadecimal keyed hash of the parts."""
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), *parts), 256)


def feistel(a: Column, b: Column, base_a: Column, base_b: Column, key: str, kind: str) -> Column:
    """The permuted pair as a struct (a, b) of BIGINT, with 0 <= a < base_a, 0 <= b < base_b."""

    def noise(round_no: Column, half: Column, base: Column) -> Column:
        number = F.conv(F.substring(digest(key, kind, round_no.cast("string"), half.cast("string")), 1, 15), 16, 10)
        return F.pmod(number.cast("bigint"), base)

    def turn(pair: Column, round_no: Column) -> Column:
        left, right = pair["a"], pair["b"]
        return F.when(
            round_no % 2 == 0,
            F.struct(F.pmod(left + noise(round_no, right, base_a), base_a).alias("a"), right.alias("b")),
        ).otherwise(F.struct(left.alias("a"), F.pmod(right + noise(round_no, left, base_b), base_b).alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of digits as another of the same length (up to 36 digits)."""
    size = F.length(digits)
    left = F.floor(size / 2).cast("int")
    right = size - left
    base = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    pair = feistel(
        F.concat(F.lit("0"), F.substring(digits, F.lit(1), left)),
        F.concat(F.lit("0"), F.substring(digits, left + 1, right)),
        base(left),
        base(right),
        key,
        kind,
    )
    join = lambda p: F.concat(
        F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")
    )
    return F.element_at(F.transform(F.array(pair), join), 1)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))

    def put(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            (state["next"] + is_digit.cast("int")).alias("next"),
            F.concat(
                state["out"], F.when(is_digit, F.substring(digits, state["next"], F.lit(1))).otherwise(c)
            ).alias("out"),
        )

    return F.aggregate(F.split(form, ""), start, put)["out"]


def luhn_sum(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def card(value: Column, key: str) -> Column:
    def permute(digits: Column) -> Column:
        payload = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return let(
            payload,
            lambda p: refilled(
                value, F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string"))
            ),
        )

    return let(only_digits(value), lambda d: F.when(luhn_sum(d) == 0, permute(d)))


def ssn(value: Column, key: str) -> Column:
    area = F.substring(value, 1, 3).cast("bigint")
    group = F.substring(value, 5, 2).cast("bigint")
    serial = F.substring(value, 8, 4).cast("bigint")
    # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
    rank = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    pair = feistel(rank, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def show(p: Column) -> Column:
        place = F.floor(p["a"] / 99)
        return F.format_string(
            "%03d-%02d-%04d",
            place + 1 + F.when(place >= 665, 1).otherwise(0),
            p["a"] % 99 + 1,
            p["b"] + 1,
        )

    return let(pair, show)


def rest_by_97(account: Column, country_and_check: Column) -> Column:
    """The remainder of an IBAN whose first four characters have moved to its end."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97).otherwise(
            (total * 100 + F.ascii(c) - 55) % 97
        )

    characters = F.split(F.concat(account, country_and_check), "")
    return F.aggregate(F.filter(characters, lambda c: c != ""), F.lit(0), add)


def without_blanks(value: Column) -> Column:
    return F.translate(value, " ", "")


def iban_holds(value: Column) -> Column:
    """Whether an IBAN without blanks has the right length and check digits."""
    rest = rest_by_97(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    return F.length(value).between(15, 34) & (rest == 1)


def valid_ibans(text: Column) -> Column:
    """The IBANs of a text as written, longer ones before those they begin with. Words that
    follow a grouped one look like groups; the most groups that are valid count."""

    def longest(candidate: Column) -> Column:
        def beginnings(groups: Column) -> Column:
            counts = F.sequence(F.size(groups), F.lit(1), F.lit(-1))
            return F.transform(counts, lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))

        return F.get(F.filter(let(F.split(candidate, " "), beginnings), lambda v: iban_holds(without_blanks(v))), F.lit(0))

    found = F.transform(F.regexp_extract_all(text, F.lit(IBAN_AHEAD), F.lit(1)), longest)
    return F.sort_array(F.array_distinct(F.filter(found, lambda v: v.isNotNull())), asc=False)


def any_value(ibans: Column) -> Column:
    """The pattern of all values of a text with these IBANs."""
    own = F.concat(
        F.lit(rf"{BEFORE_IBAN}|(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:"),
        F.array_join(ibans, "|"),
        F.lit(rf")(?![0-9A-Za-z])|{AFTER_IBAN}"),
    )
    return F.when(F.size(ibans) > 0, own).otherwise(F.lit(f"{BEFORE_IBAN}|{AFTER_IBAN}"))


def iban(value: Column, key: str) -> Column:
    def renew(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def filled(digits: Column) -> Column:
            check = 98 - rest_by_97(refilled(account, digits), F.concat(country, F.lit("00")))
            return refilled(value, F.concat(F.lpad(check.cast("string"), 2, "0"), digits))

        new = permuted_digits(only_digits(account), key, "iban")
        return F.when(iban_holds(plain), let(new, filled))

    return let(without_blanks(value), renew)


def phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, rf"^(?:\+[0-9]{{1,3}}[ .\-]|\+{_CODE}|)", 0)
    number = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, refilled(number, permuted_digits(only_digits(number), key, "phone")))


def ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, "[.]"), lambda o: o.cast("bigint"))
    pair = let(
        octets, lambda o: feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
    )
    return let(
        pair,
        lambda p: F.concat_ws(
            ".",
            *((part.cast("bigint")).cast("string") for h in ("a", "b") for part in (F.floor(p[h] / 256), p[h] % 256)),
        ),
    )


def date(value: Column, key: str) -> Column:
    form = (
        F.when(F.substring(value, 5, 1) == "-", "yyyy-MM-dd")
        .when(F.substring(value, 5, 1) == "/", "yyyy/MM/dd")
        .when(F.substring(value, 3, 1) == ".", "dd.MM.yyyy")
        .otherwise("MM/dd/yyyy")
    )
    digits = only_digits(value)
    iso = (
        F.when(F.substring(value, 5, 1).isin("-", "/"), F.regexp_replace(value, "/", "-"))
        .when(
            F.substring(value, 3, 1) == ".",
            F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2)),
        )
        .otherwise(
            F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 1, 2), F.substring(digits, 3, 2))
        )
    )
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    base_a, base_b = map(F.lit, DAY_BASES)

    def show(p: Column) -> Column:
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * base_b + p["b"]).cast("int"))
        return F.call_function("date_format", moved, form)

    return let(
        day,
        lambda d: F.when(
            d.isNotNull(), let(feistel(F.floor(d / base_b), d % base_b, base_a, base_b, key, "date"), show)
        ),
    )


def email(value: Column, key: str) -> Column:
    known = F.lower(value)
    domain = F.substring_index(known, "@", -1)
    return F.concat(
        F.lit("p"),
        F.substring(digest(key, "email", known), 1, 16),
        F.lit("@d"),
        F.substring(digest(key, "domain", domain), 1, 10),
        F.lit(".invalid"),
    )


def hexadecimal(value: Column, key: str) -> Column:
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 64).cast("int")),
        lambda i: digest(key, "hex", i.cast("string"), F.lower(value)),
    )
    new = F.substring(F.array_join(blocks, ""), F.lit(1), F.length(value))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match; null where it fails validation."""
    whole = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(F.contains(value, F.lit("@")), email(value, key))
        .when(whole("hex"), hexadecimal(value, key))
        .when(whole("iban"), iban(value, key))
        .when(whole("ipv4"), ipv4(value, key))
        .when(whole("date"), date(value, key))
        .when(whole("ssn"), ssn(value, key))
        .when(whole("phone"), phone(value, key))
        .otherwise(card(value, key))
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in the text column; adds ``n_values``."""
    old, new, any_ = (_free_name(docs, name) for name in ("_found", "_new", "_any"))
    ibans = F.when(F.col(text).rlike(HINT), valid_ibans(F.col(text)))
    named = docs.drop("n_values").withColumn(any_, ibans)
    named = named.withColumn(any_, F.when(F.col(any_).isNotNull(), any_value(F.col(any_))))
    named = named.withColumn(old, F.regexp_extract_all(text, F.col(any_), F.lit(0)))
    values = F.transform(old, lambda m: pseudonym(m, key))
    changed = named.withColumn(new, F.when(F.size(old) > 0, values))
    gaps = F.split(F.col(text), F.col(any_), -1)
    filled = F.zip_with(old, new, lambda before, after: F.coalesce(after, before))
    parts = F.zip_with(gaps, filled, lambda gap, value: F.array(gap, F.coalesce(value, F.lit(""))))
    replaced = F.size(F.filter(new, lambda v: v.isNotNull()))
    return changed.withColumns(
        {
            text: F.when(F.size(old) > 0, F.array_join(F.flatten(parts), "")).otherwise(F.col(text)),
            "n_values": F.when(F.col(new).isNull(), 0).otherwise(replaced).cast("bigint"),
        }
    ).drop(old, new, any_)


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name
