"""Format-preserving pseudonyms of personal numbers and dates, by keyed Feistel networks.

Numbers and dates are found, validated and brought to a plain form, and that form is
permuted among all forms of its kind. So the same value has the same pseudonym in every
document and however it is written, two values never share one, and a pseudonym is a
valid value of its kind: a payment card number passes its check digit, a date exists. The
characters around the digits stay. E-mail addresses have no numbers to permute; a keyed
digest takes their place. Everything is made of Spark's functions and moves no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# Dates of these years are permuted among themselves: 73,049 days, which are 17 times 4,297.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAY_PARTS = (17, 4297)
DEMO_KEY = "demo-key: set spark.ferrywright.pseudonym.key"

_START, _END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ADDRESS = _START + r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])"
DATE = _START + r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})" + r"(?:(?=[Tt][0-9]{2}:?[0-9]{2})|(?![0-9A-Za-z]))"
CARD = _START + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _END
# More than four groups of four digits: any four neighbours may be the card.
GROUPS = _START + r"[0-9]{4}(?:[ -][0-9]{4}){4,}(?:[ -][0-9]{1,3})?" + _END
# A card of four groups of four, with a short number behind it.
TAILED = "^([0-9]{4}(?:[ -][0-9]{4}){3})([ -][0-9]{1,3})$"
SOCIAL = _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END
PHONE = (
    r"(?<![0-9A-Za-z+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _END
    + r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}" + _END
    + r"|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}" + _END
)
# The two groups of DATE are the first two of the whole.
ANY = "|".join((DATE, EMAIL, ADDRESS, SOCIAL, GROUPS, CARD, PHONE))
# What a text must have for any of them.
HINT = "@|[0-9]"


def _feistel(left: Column, right: Column, left_size, right_size, key: str, kind: str) -> tuple[Column, Column]:
    """A keyed permutation of the pairs below (left_size, right_size)."""

    def mixed(value: Column, step: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(at: Column, step: Column) -> Column:
        even = step % 2 == 0
        a = F.when(even, F.pmod(at["a"] + mixed(at["b"], step), left_size)).otherwise(at["a"])
        b = F.when(even, at["b"]).otherwise(F.pmod(at["b"] + mixed(at["a"], step), right_size))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return out["a"], out["b"]


def _pair(left: Column, right: Column, left_size, right_size, key, kind, make) -> Column:
    """`make(a, b)` of the permuted pair, which is computed once."""
    a, b = _feistel(left, right, left_size, right_size, key, kind)
    once = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: make(p["a"], p["b"]))
    return F.get(once, F.lit(0))


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of one length, from 2 to 36 digits."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    rest = n - half
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1)
    ten = F.lit(10).cast("double")
    sizes = F.pow(ten, half).cast("long"), F.pow(ten, rest).cast("long")
    return _pair(
        left, right, *sizes, key, kind,
        lambda a, b: F.concat(F.lpad(a.cast("string"), half, "0"), F.lpad(b.cast("string"), rest, "0")),
    )


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum from the right; every second digit is doubled, beginning with place `doubled`."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == doubled, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int")),
    )
    return F.aggregate(places, F.lit(0), lambda total, x: total + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _card(digits: Column, key: str) -> Column:
    """First digit and check rule stay; the digits between are permuted."""
    inner = permute_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card")
    body = F.concat(F.substring(digits, 1, 1), inner)
    check = F.get(F.transform(F.array(body), lambda x: F.concat(x, ((10 - _luhn_sum(x, 0) % 10) % 10).cast("string"))), F.lit(0))
    return check


def _cards_among(m: Column, key: str) -> Column:
    """A run of groups of digits in which every card of four neighbouring groups is hidden, the first ones first."""
    # Each group with the separator behind it.
    groups = F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"))

    def step(state: Column, i: Column) -> Column:
        four = F.array_join(F.slice(groups, i + 1, F.lit(4)), "")
        digits = F.regexp_replace(four, "[^0-9]", "")
        is_card = (F.length(digits) == 16) & four.rlike("^(?:[0-9]{4}[ -]?){4}$") & luhn_valid(digits)
        inside = state["skip"] > 0
        shown = F.when(inside, F.lit("")).when(is_card, _refilled(four, _card(digits, key))).otherwise(F.get(groups, i))
        skip = F.when(inside, state["skip"] - 1).when(is_card, 3).otherwise(0)
        return F.struct(F.concat(state["out"], shown).alias("out"), skip.alias("skip"))

    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda state: state["out"])


def _refilled(original: Column, digits: Column) -> Column:
    """`original` with its digits replaced in order by those of `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        out = F.concat(state["out"], F.when(is_digit, F.substr(digits, state["at"], F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (state["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(original, ""), start, put, lambda state: state["out"])


def _day_first(m: Column) -> Column:
    """Whether a date that ends with its year begins with the day: with slashes the month comes first if it can."""
    parts = F.split(m, "[-/.]")
    first, second = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
    return (first > 12) | (~m.contains("/") & (second <= 12))


def _day_of(m: Column) -> Column:
    """Days since the first day of a written date; null unless it exists and is in range."""
    parts = F.split(m, "[-/.]")
    p = [F.get(parts, F.lit(i)).cast("int") for i in range(3)]
    year_first, day_first = m.rlike("^[0-9]{4}"), _day_first(m)
    year = F.when(year_first, p[0]).otherwise(p[2])
    month = F.when(year_first | day_first, p[1]).otherwise(p[0])
    day = F.when(year_first, p[2]).when(day_first, p[0]).otherwise(p[1])
    real = month.between(1, 12) & day.between(1, 31) & year.between(int(FIRST_DAY[:4]), int(LAST_DAY[:4]))
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(real, F.when(day <= last, F.datediff(F.make_date(year, month, day), F.lit(FIRST_DAY).cast("date"))))


def _date(m: Column, key: str) -> Column:
    """The permuted date, written in the order, with the separator and at least the widths of the original."""
    days, size = _day_of(m), DAY_PARTS[1]

    def put(a: Column, b: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (a * size + b).cast("int"))
        y, mo, d = F.year(day), F.month(day), F.dayofmonth(day)
        order = F.when(m.rlike("^[0-9]{4}"), F.array(y, mo, d)).when(_day_first(m), F.array(d, mo, y))
        old = F.split(m, "[-/.]")
        padded = F.zip_with(
            order.otherwise(F.array(mo, d, y)), old,
            lambda new, was: F.lpad(new.cast("string"), F.greatest(F.length(new.cast("string")), F.length(was)), "0"),
        )
        return F.array_join(padded, "|").alias("w")

    joined = _pair((days / size).cast("long"), days % size, F.lit(DAY_PARTS[0]), F.lit(size), key, "date", put)
    return F.when(days.isNotNull(), F.replace(joined, F.lit("|"), F.regexp_extract(m, "[-/.]", 0)))


def _address(m: Column, key: str) -> Column:
    """An IPv4 address; null unless all four numbers are below 256."""
    p = [F.get(F.split(m, "[.]"), F.lit(i)).cast("int") for i in range(4)]
    valid = (p[0] < 256) & (p[1] < 256) & (p[2] < 256) & (p[3] < 256)
    size = F.lit(65536)

    def put(a: Column, b: Column) -> Column:
        return F.array_join(F.transform(F.array(a / 256, a % 256, b / 256, b % 256), lambda x: x.cast("long").cast("string")), ".")

    return F.when(valid, _pair(p[0] * 256 + p[1], p[2] * 256 + p[3], size, size, key, "address", put))


def _phone(m: Column, digits: Column, key: str) -> Column:
    """Numbers of the North American plan stay in it; of others the first two digits stay."""
    national = F.substr(digits, F.length(digits) - 9)
    ours = digits.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & (~m.startswith("+") | (F.length(digits) == 11))
    area, rest = F.substring(national, 1, 3).cast("long"), F.substring(national, 4, 7).cast("long")
    here = _pair(
        area - 200, rest - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone",
        lambda a, b: F.concat((a + 200).cast("string"), (b + 2_000_000).cast("string")),
    )
    other = F.concat(F.substring(digits, 1, 2), permute_digits(F.substr(digits, F.lit(3)), key, "phone2"))
    lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
    return F.when(ours, _refilled(m, F.concat(lead, here))).when(F.length(digits) >= 8, _refilled(m, other))


def _social(m: Column, digits: Column, key: str) -> Column:
    """A social security number; null if its area, group or serial is never given out. The first digit may change."""
    valid = ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    area = F.substring(digits, 1, 3).cast("long")
    # The areas 1 to 899 without 666 are 898, the groups times the serials 99 times 9,999.
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    tail = (F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1

    def put(a: Column, b: Column) -> Column:
        number = F.when(a >= 665, a + 2).otherwise(a + 1)
        texts = (number, 3), ((b / 9999).cast("long") + 1, 2), (b % 9999 + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in texts])

    return F.when(valid, _pair(index, tail, F.lit(898), F.lit(99 * 9999), key, "social", put))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself where it is no valid value."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))
    out = F.when(m.contains("@"), email)
    out = out.when(m.rlike(f"^(?:{DATE})$"), _date(m, key))
    out = out.when(m.rlike(f"^(?:{ADDRESS})$"), _address(m, key))
    out = out.when(m.rlike(f"^(?:{SOCIAL})$"), _social(m, digits, key))
    out = out.when(m.rlike(f"^(?:{GROUPS})$"), _cards_among(m, key))
    out = out.when(m.rlike(f"^(?:{CARD})$") & luhn_valid(digits), _refilled(m, _card(digits, key)))
    # The short number behind a card may be its own: then the sixteen digits before it are the card.
    front, tail = F.regexp_extract(m, TAILED, 1), F.regexp_extract(m, TAILED, 2)
    sixteen = F.regexp_replace(front, "[^0-9]", "")
    out = out.when(m.rlike(TAILED) & luhn_valid(sixteen), F.concat(_refilled(front, _card(sixteen, key)), tail))
    out = out.when(m.rlike(f"^(?:{PHONE})$"), _phone(m, digits, key))
    return F.coalesce(out, m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with personal values of `text` replaced; all other columns as they are, null texts null.

    Values that fail validation stay, and so do dates outside the years that are permuted.
    Repeated rows get equal results. An empty table gives no rows.
    """
    body = F.col(text).cast("string")
    found = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    between = F.split(body, ANY, -1)
    new = F.transform(found, lambda m: pseudonym(m, key))
    # One more piece of text than matches: piece, pseudonym, piece, and so on.
    joined = F.array_join(F.zip_with(between, new, lambda piece, p: F.concat(piece, F.coalesce(p, F.lit("")))), "")
    return docs.withColumn(text, F.when(body.rlike(HINT) & body.rlike(ANY), joined).otherwise(body))
