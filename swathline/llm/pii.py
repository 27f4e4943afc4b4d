"""Format-preserving pseudonyms for personal data.

Candidates are found by pattern and then validated: card numbers by their check digit, account numbers (IBAN) by modulo 97,
dates by the calendar, addresses and social security numbers by the ranges of their parts, phone numbers by their length. A valid value is
replaced by a keyed permutation of its own format: a Feistel network over the valid values, with SHA-256 of the key as
its round function. Numbers use mixed radices that multiply to exactly the number of valid values, so the result is always
valid again and two values never get the same pseudonym; check digits are computed anew. E-mail names, access keys and
passwords are permuted character by character within digits and letters. The same value, however written, gets the same
pseudonym in all documents.

Dates of 1800-01-01 to 2199-12-31 are permuted among themselves (146,097 days, one cycle of the calendar). What does not
validate stays as it is, as does all other text.

Null text: null, nothing found. Empty text: empty. Repeated rows get equal results. Empty table: empty result. All other
columns are carried along; the result's own columns are named by parameters. No row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
# The countries' lengths of account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _known_ibans() -> str:
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        tail = rf" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    return "|".join(forms)


# The patterns of the kinds, in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9_\-/+]{8,}",
    # The country's length first, so that a word behind the number isn't taken for a part of it.
    "iban": rf"\b(?:{_known_ibans()}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\d+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    + "".join(rf"|(?<![\d+])(?<!\d[ .-])(?:1{d})?\d{{3}}{d}\d{{3}}{d}\d{{4}}(?![ .-]?\d)" for d in ("-", r"\.", " ")),
    # Ends before a group that begins a date or an address, and if possible before one that begins another card.
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])(?!(?<=[ -]\d{1,3})[./]\d)(?!(?<=[ -]\d{1,4})(?: \d{1,4}){2})"
    r"|(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
KINDS = tuple(PATTERNS)
#: What every value of any kind holds: a text without it is passed over at less cost.
MAY_HOLD = "[0-9@=:]|AKIA"
#: Slashed dates are read month first; where that is no valid day, day first. Later formats win.
MONTH_FIRST, DAY_FIRST = "MM/dd/yyyy", "dd/MM/yyyy"
DATE_FORMATS = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", DAY_FIRST), ("/", MONTH_FIRST))
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _round(key: str, number: int, kind: str, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(number)), half.cast("string")).cast("binary"), 256)


def feistel_number(value: Column, left: int, right: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1."""

    def mixed(number: int, half: Column) -> Column:
        return F.conv(F.substring(_round(key, number, kind, half), 1, 14), 16, 10).cast("bigint")

    a, b = F.floor(value / right).cast("bigint"), F.pmod(value, F.lit(right))
    pair = F.struct(a.alias("a"), b.alias("b"))
    for number in range(ROUNDS):
        pair = F.transform(F.array(pair), _number_round(number, left, right, mixed))[0]
    return F.transform(F.array(pair), lambda p: p["a"] * F.lit(right).cast("bigint") + p["b"])[0]


def _number_round(number: int, left: int, right: int, mixed):
    def moved(part: Column, by: Column, size: int) -> Column:
        return F.pmod(part + F.pmod(mixed(number, by), F.lit(size)), F.lit(size))

    def even(p: Column) -> Column:
        return F.struct(moved(p["a"], p["b"], left).alias("a"), p["b"].alias("b"))

    def odd(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), moved(p["b"], p["a"], right).alias("b"))

    return odd if number % 2 else even


def _turned(text: Column, stream: Column) -> Column:
    """Each ASCII digit and letter moved on within its class by a byte of the hexadecimal stream."""

    def one(char: Column, at: Column) -> Column:
        code = F.ascii(char)
        move = F.conv(F.substr(stream, F.pmod(at, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + move, F.lit(size)))
        return (
            F.when(char.rlike("^[0-9]$"), within(48, 10))
            .when(char.rlike("^[a-z]$"), within(97, 26))
            .when(char.rlike("^[A-Z]$"), within(65, 26))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the texts with the same classes of characters at the same places."""
    cut = F.floor(F.length(text) / 2).cast("int")
    pair = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1, F.length(text)).alias("b"))
    for number in range(ROUNDS):
        pair = F.transform(F.array(pair), _text_round(number, key, kind))[0]
    return F.transform(F.array(pair), lambda p: F.concat(p["a"], p["b"]))[0]


def _text_round(number: int, key: str, kind: str):
    def even(p: Column) -> Column:
        return F.struct(_turned(p["a"], _round(key, number, kind, p["b"])).alias("a"), p["b"].alias("b"))

    def odd(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), _turned(p["b"], _round(key, number, kind, p["a"])).alias("b"))

    return odd if number % 2 else even


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""

    def step(acc: Column, char: Column) -> Column:
        digit = char.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(char)).alias("out"),
            (acc["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    def weight(char: Column, at: Column) -> Column:
        d = char.cast("int")
        return F.when(F.pmod(at, F.lit(2)) == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """The remainder of an account number, letters counting as two digits."""

    def step(acc: Column, char: Column) -> Column:
        letter = char.rlike("^[A-Z]$")
        return F.when(letter, F.pmod(acc * 100 + F.ascii(char) - 55, F.lit(97))).otherwise(
            F.pmod(acc * 10 + F.when(letter, F.lit("0")).otherwise(char).cast("int"), F.lit(97))
        )

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _pad(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _card(m: Column, key: str) -> Column:
    """The longest valid number that begins the candidate and ends with one of its groups of digits; the rest stays."""
    starts = F.array(*(F.regexp_extract(m, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in range(19, 12, -1)))
    valid = F.filter(starts, lambda p: F.when(p != "", F.pmod(luhn_sum(_digits(p)), F.lit(10)) == 0).otherwise(False))
    rest = lambda p: F.substr(m, F.length(p) + 1, F.length(m))
    return F.get(F.transform(F.slice(valid, 1, 1), lambda p: F.concat(_card_number(p, key), rest(p))), F.lit(0))


def _card_number(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substr(digits, F.lit(2), F.length(digits) - 2)
    start = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_text(body, key, "card"))
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(start, F.lit("0"))), F.lit(10)), F.lit(10))
    return _refill(m, F.concat(start, check.cast("string")))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o)
    new = feistel_number(value, 65536, 65536, key, "ip")
    text = F.transform(
        F.array(new),
        lambda v: F.concat_ws(".", *(F.pmod(F.floor(v / (1 << s)).cast("bigint"), F.lit(256)).cast("string") for s in (24, 16, 8, 0))),
    )[0]
    return F.when(F.forall(octets, lambda o: o <= 255), text)


def _date(m: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for mark, form in DATE_FORMATS:
        day = F.try_to_date(m, form)
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_number(number, *DAYS, key, "date").cast("int"))
        known = F.contains(m, F.lit(mark)) & number.between(0, DAYS[0] * DAYS[1] - 1)
        if form == DAY_FIRST:
            # The day can't be taken for a month, neither in the value nor in its pseudonym.
            new = F.when(F.day(new) > 12, F.date_format(new, form)).otherwise(F.date_format(new, MONTH_FIRST))
        else:
            new = F.date_format(new, form)
        out = F.coalesce(F.when(known, new), out)
    return out


def _ssn(m: Column, key: str) -> Column:
    digits = _digits(m)
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("bigint")
    new = feistel_number(place * (99 * 9999) + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def text(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("bigint")
        rest = F.pmod(v, F.lit(99 * 9999))
        a = a + 1 + (a >= 665).cast("bigint")
        return F.concat(_pad(a, 3), _pad(F.floor(rest / 9999).cast("bigint") + 1, 2), _pad(F.pmod(rest, F.lit(9999)) + 1, 4))

    return F.when(valid, _refill(m, F.transform(F.array(new), text)[0]))


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    prefixed = (m.startswith("+1") | ~m.startswith("+")) & (F.length(digits) == 11) & digits.startswith("1")
    national = F.when(prefixed, F.substr(digits, F.lit(2), F.length(digits))).when(~m.startswith("+"), digits)
    american = F.length(national) == 10
    new = feistel_number(national.cast("bigint"), 100_000, 100_000, key, "phone")

    def text(v: Column) -> Column:
        return F.concat(F.when(prefixed, F.lit("1")).otherwise(F.lit("")), _pad(v, 10))

    # Other numbering plans: the first three digits may hold the country and stay.
    foreign = m.startswith("+") & ~m.startswith("+1") & F.length(digits).between(8, 15)
    other = F.concat(
        F.substr(digits, F.lit(1), F.lit(3)), feistel_text(F.substr(digits, F.lit(4), F.length(digits)), key, "phone")
    )
    return F.when(american, _refill(m, F.transform(F.array(new), text)[0])).when(foreign, _refill(m, other))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
    valid = F.length(plain).between(15, 34) & (mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    new = feistel_text(body, key, "iban")

    def text(b: Column) -> Column:
        return F.concat(country, _pad(98 - mod97(F.concat(b, country, F.lit("00"))), 2), b)

    whole = F.transform(F.array(new), text)[0]

    def step(acc: Column, char: Column) -> Column:
        gap = char == " "
        return F.struct(
            F.concat(acc["out"], F.when(gap, char).otherwise(F.substr(whole, acc["at"], F.lit(1)))).alias("out"),
            (acc["at"] + F.when(gap, 0).otherwise(1)).alias("at"),
        )

    spaced = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda a: a["out"])
    return F.when(valid, F.when(plain == m, whole).otherwise(spaced))


def _email(m: Column, key: str) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    # Names of one character have too few pseudonyms to hide among; the host's letters don't change.
    return F.concat(feistel_text(name, key, "email"), F.lit("@"), host)


def _secret(m: Column, key: str) -> Column:
    label = F.regexp_extract(m, r"^(AKIA|(?i:password|passwd|secret|token|api_key)\s?[=:]\s?\"?)", 1)
    return F.concat(label, feistel_text(F.substr(m, F.length(label) + 1, F.length(m)), key, "secret"))


_MAKERS = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


def pseudonym(match: Column, kind: str, key: str) -> Column:
    """The pseudonym of a value of a kind; null if the value isn't valid."""
    return _MAKERS[kind](match, key)


def _is_kind(kind: str):
    return lambda r: r["kind"] == kind


def pseudonymise(
    docs: DataFrame, key: str, text_col: str = "text", kinds: tuple[str, ...] = KINDS, counts: str = "n_", total: str = "n_private"
) -> DataFrame:
    """The documents with validated values replaced, the number of them in all and by kind."""
    pattern = "|".join(f"({PATTERNS[k]})" for k in kinds)
    text = F.col(text_col).cast("string")
    hit = text.rlike(MAY_HOLD) & text.rlike(pattern)
    found = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    between = F.when(hit, F.split(text, pattern))

    def replaced(m: Column) -> Column:
        tries = F.array(
            *(
                F.struct(
                    F.lit(k).alias("kind"), m.alias("old"), F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), pseudonym(m, k, key)).alias("new")
                )
                for k in kinds
            )
        )
        none = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("old"), F.lit(None).cast("string").alias("new"))
        return F.coalesce(F.get(F.filter(tries, lambda r: r["new"].isNotNull()), F.lit(0)), none)

    marked = docs.withColumn("_between", between).withColumn("_found", F.transform(found, replaced))
    joined = F.array_join(
        F.zip_with("_between", "_found", lambda s, r: F.concat(s, F.coalesce(r["new"], r["old"], F.lit("")))), ""
    )
    valid = F.filter("_found", lambda r: r["new"].isNotNull())
    return marked.select(
        *(F.coalesce(joined, text).alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.coalesce(F.size(valid), F.lit(0)).cast("bigint").alias(total),
        *(
            F.coalesce(F.size(F.filter(valid, _is_kind(k))), F.lit(0)).cast("bigint").alias(f"{counts}{k}") for k in kinds
        ),
    )
