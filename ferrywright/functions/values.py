"""Value transforms and predicates, Column in and Column out.

Everything here is built from Spark's own expressions, so a projection of any number
of them stays in one generated stage and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARKER = "\\N"

# Spellings of booleans that become 1 and 0.
TRUE_WORDS = ("true", "t", "yes", "y")
FALSE_WORDS = ("false", "f", "no", "n")

# Text layouts of compact and printed date-times.
COMPACT_DATETIME = "yyyyMMddHHmmss"
COMPACT_DATE = "yyyyMMdd"

# The characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Optional minus, digits, at most one dot; a lone dot is not a number.
NUMERIC_TEXT = r"^-?[0-9]+\.?[0-9]*$|^-?\.[0-9]+$"


# --- predicates ---------------------------------------------------------------


def is_marker(c: Column, marker: str = NULL_MARKER) -> Column:
    return c == F.lit(marker)


def is_numeric_text(c: Column) -> Column:
    return c.rlike(NUMERIC_TEXT)


def is_digits(c: Column, length: int) -> Column:
    return c.rlike(f"^[0-9]{{{length}}}$")


def needs_quote(c: Column, sep: str = ",", quote: str = '"') -> Column:
    """Whether a CSV field has to be quoted: separator, quote, CR or LF inside."""
    return c.contains(sep) | c.contains(quote) | c.contains("\n") | c.contains("\r")


# --- NULL and empty -----------------------------------------------------------


def marker_to_null(c: Column, marker: str = NULL_MARKER) -> Column:
    return F.when(c != F.lit(marker), c)


def null_to_marker(c: Column, marker: str = NULL_MARKER) -> Column:
    return F.coalesce(c, F.lit(marker))


def null_if(c: Column, values: Iterable[str]) -> Column:
    """NULL for the listed texts, compared with case."""
    return F.when(~c.isin(list(values)), c)


def null_identifiers(
    c: Column, values: Iterable[str] = (), case_sensitive: bool = True, regex: str | None = None
) -> Column:
    """NULL for the listed texts or for texts a pattern finds."""
    words = list(values)
    probe = c if case_sensitive else F.lower(c)
    hit = F.lit(False)
    if words:
        hit = hit | probe.isin(words if case_sensitive else [w.lower() for w in words])
    if regex:
        hit = hit | c.rlike(regex)
    return F.when(~hit, c)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- text ---------------------------------------------------------------------


def trim_text(c: Column) -> Column:
    """Strip Unicode white space at both ends; `trim` alone only knows the blank."""
    # Most values have nothing to strip; looking at both ends is cheaper than trying.
    blanks = list(WHITE_SPACE)
    padded = F.left(c, F.lit(1)).isin(blanks) | F.right(c, F.lit(1)).isin(blanks)
    return F.when(padded, F.btrim(c, F.lit(WHITE_SPACE))).otherwise(c)


def newline_to(c: Column, replacement: str = " ") -> Column:
    return F.regexp_replace(c, r"\r?\n", replacement)


# --- date-times ---------------------------------------------------------------


def expand_datetime(c: Column) -> Column:
    """14 digits as `yyyy-MM-dd HH:mm:ss` text; other values unchanged, no calendar check."""
    day = _joined(c, "-", (1, 4), (5, 2), (7, 2))
    time = _joined(c, ":", (9, 2), (11, 2), (13, 2))
    return F.when(_compact(c, 14), F.concat(day, F.lit(" "), time)).otherwise(c)


def expand_date(c: Column) -> Column:
    """8 digits as `yyyy-MM-dd` text; other values unchanged."""
    return F.when(_compact(c, 8), _joined(c, "-", (1, 4), (5, 2), (7, 2))).otherwise(c)


def _compact(c: Column, digits: int) -> Column:
    # The length test is cheap and spares most values the pattern.
    return (F.octet_length(c) == digits) & is_digits(c, digits)


def _joined(c: Column, sep: str, *spans: tuple[int, int]) -> Column:
    return F.concat_ws(sep, *[F.substring(c, start, length) for start, length in spans])


def parse_datetime(c: Column, formats: Iterable[str] = (COMPACT_DATETIME,)) -> Column:
    """First format that fits, in the given order; NULL when none does."""
    # The parse is bound to the session zone and so is the way back to wall-clock time.
    parsed = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def parse_date(c: Column, fmt: str = COMPACT_DATE) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def truncate_datetime(c: Column, unit: str) -> Column:
    """Drop what the target type cannot hold: `second` for DATETIME, `day` for DATE."""
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def compact_datetime(c: Column) -> Column:
    """Date or timestamp as 14 digits; fraction and zone are dropped."""
    return F.date_format(c, COMPACT_DATETIME)


# --- booleans -----------------------------------------------------------------


def boolean_to_bit(c: Column) -> Column:
    """Boolean words as '1' and '0'; anything else unchanged."""
    word = F.lower(trim_text(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit("1")).when(word.isin(*FALSE_WORDS), F.lit("0")).otherwise(c)


def map_boolean(c: Column, mapping: Mapping[str, bool]) -> Column:
    """Boolean for the listed words, NULL for the rest."""
    pairs = [F.lit(x) for word, value in mapping.items() for x in (word, value)]
    return F.create_map(*pairs)[c]


# --- binary and charsets ------------------------------------------------------

# Configured charset name -> Java charset.
CHARSETS = {
    "": "UTF-8",
    "UTF-8": "UTF-8",
    "UTF8": "UTF-8",
    "GBK": "GBK",
    "GB2312": "GBK",
    "GB18030": "GB18030",
    "LATIN1": "ISO-8859-1",
    "ISO-8859-1": "ISO-8859-1",
    "LATIN9": "ISO-8859-15",
    "ISO-8859-15": "ISO-8859-15",
    "WINDOWS-1252": "windows-1252",
    "SHIFT_JIS": "Shift_JIS",
    "SJIS": "Shift_JIS",
}


def java_charset(name: str) -> str:
    try:
        return CHARSETS[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown charset {name!r}") from None


def decode_bytes(c: Column, charset: str) -> Column:
    """Bytes of a legacy charset as text. Needs the settings of `session.configure`."""
    return F.decode(c, java_charset(charset))


def decode_or_keep(c: Column, charset: str) -> Column:
    """A struct of the text and, where some bytes stand for no character, the bytes as they came.

    Such bytes show as U+FFFD in the text; bytes that spell that character themselves are
    told from them by encoding the text again.
    """
    text = decode_bytes(c, charset)
    lost = F.contains(text, F.lit("\ufffd")) & (F.encode(text, java_charset(charset)) != c)
    return F.struct(text.alias("text"), F.when(lost, c).alias("undecodable"))


def binary_to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def hex_to_binary(c: Column) -> Column:
    """Bytes, or NULL for text that is not an even number of hex digits."""
    even = c.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(even, F.try_to_binary(F.when(even, c), F.lit("hex")))


# --- value -> text ------------------------------------------------------------


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Text of any value as the landing files and scripts print it."""
    if isinstance(dtype, T.BinaryType):
        return binary_to_hex(c)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return compact_datetime(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _float_text(c, dtype)
    return c.cast("string")


def _float_text(c: Column, dtype: T.DataType) -> Column:
    """Shortest digits, plain between 1e-4 and 1e21, otherwise with a two-digit exponent."""
    size = F.abs(c)
    shortest = c.cast("string")
    # In this range the shortest digits are plain already; most values are whole or end in no zero.
    whole = c.cast("long")
    usual = (
        F.when(whole.cast(dtype) == c, whole.cast("string"))
        .when(shortest.endswith("0"), F.regexp_replace(shortest, r"\.?0+$", ""))
        .otherwise(shortest)
    )
    plain = F.when(size < 1e15, shortest.cast("decimal(38,21)").cast("string")).otherwise(
        shortest.cast("decimal(38,0)").cast("string")
    )
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    mantissa = F.regexp_replace(F.split_part(shortest, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(shortest, F.lit("E"), F.lit(2))
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.lpad(F.regexp_replace(power, "^-", ""), 2, "0")
    # lpad would cut a three-digit exponent.
    digits = F.when(F.length(power) >= 3, F.regexp_replace(power, "^-", "")).otherwise(digits)
    # Spark says Infinity, the landing files say +Inf and -Inf.
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), "NaN")
        .when(size == float("inf"), F.when(c > 0, "+Inf").otherwise("-Inf"))
        .when(c == 0, F.when(shortest.startswith("-"), "-0").otherwise("0"))
        .when((size >= 1e-3) & (size < 1e7), usual)
        .when((size >= 1e-4) & (size < 1e21), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )
