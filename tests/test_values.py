from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions import literals as L
from ferrywright.functions import values as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("123", True), ("-42", True), ("3.14", True), ("-0.5", True), ("42.", True), ("0", True), (".5", True),
        ("", False), ("abc", False), ("12a", False), ("1.2.3", False), ("-", False), (".", False), ("1e5", False),
    ],
)
def test_numeric_text(spark, text, expected):
    assert one(spark, text, V.is_numeric_text) is expected


@pytest.mark.parametrize(
    "value,dialect,marker,expected",
    [
        ("\\N", "postgres", "\\N", "NULL"),
        ("\\N", "oracle", "\\N", "NULL"),
        ("NULL", "mysql", "NULL", "NULL"),
        ("123", "postgres", "\\N", "123"),
        ("-42.5", "oracle", "\\N", "-42.5"),
        ("hello", "postgres", "\\N", "'hello'"),
        ("it's", "postgres", "\\N", "'it''s'"),
        ("", "oracle", "\\N", "NULL"),
        ("", "postgres", "\\N", "''"),
        ("", "mysql", "\\N", "''"),
    ],
)
def test_sql_literal(spark, value, dialect, marker, expected):
    assert one(spark, value, lambda c: L.sql_literal(c, dialect, marker)) == expected


def test_typed_literal_follows_the_type(spark):
    assert one(spark, "007", lambda c: L.typed_literal(c, T.StringType())) == "'007'"
    assert one(spark, 7, lambda c: L.typed_literal(c, T.IntegerType()), "int") == "7"
    assert one(spark, None, lambda c: L.typed_literal(c, T.IntegerType()), "int") == "NULL"
    assert one(spark, float("nan"), lambda c: L.typed_literal(c, T.DoubleType()), "double") == "'NaN'"


@pytest.mark.parametrize(
    "value,expected",
    [
        (0.0, "0"), (-0.0, "-0"), (5000.0, "5000"), (0.1, "0.1"), (12345678.9, "12345678.9"), (1e20, "1" + "0" * 20),
        (1e21, "1e+21"), (1.5e-5, "1.5e-05"), (1e-4, "0.0001"), (1e300, "1e+300"), (-2.5, "-2.5"),
        (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (float("nan"), "NaN"), (None, None),
    ],
)
def test_float_text(spark, value, expected):
    assert one(spark, value, lambda c: V.value_text(c, T.DoubleType()), "double") == expected


@pytest.mark.parametrize("space", ["　", " ", "\t\n", " ", "\x85", "\x0b"])
def test_trim_knows_unicode_blanks(spark, space):
    assert one(spark, f"{space}a b{space}", V.trim_text) == "a b"


def test_trim_keeps_zero_width_and_inner_blanks(spark):
    assert one(spark, "​a　b", V.trim_text) == "​a　b"
    assert one(spark, "　 \t", V.trim_text) == ""


@pytest.mark.parametrize(
    "text,expected",
    [
        ("19801217000000", "1980-12-17 00:00:00"),
        ("19801399000000", "1980-13-99 00:00:00"),
        ("1980121700000", "1980121700000"),
        ("1980121700000x", "1980121700000x"),
        (None, None),
    ],
)
def test_expand_datetime(spark, text, expected):
    assert one(spark, text, V.expand_datetime) == expected


def test_parse_rejects_impossible_dates(spark):
    assert one(spark, "19801399000000", V.parse_datetime) is None
    assert one(spark, "19801301", V.parse_date) is None


@pytest.mark.parametrize(
    "text,expected",
    [(" TRUE ", "1"), ("t", "1"), ("Yes", "1"), ("y", "1"), ("False", "0"), ("f", "0"), ("NO", "0"), ("n", "0"),
     ("1", "1"), ("maybe", "maybe"), (None, None)],
)
def test_boolean_words(spark, text, expected):
    assert one(spark, text, V.boolean_to_bit) == expected


@pytest.mark.parametrize("text,expected", [("00ff", b"\x00\xff"), ("", b""), ("abc", None), ("zz", None), ("0 ", None)])
def test_hex_to_binary(spark, text, expected):
    got = one(spark, text, V.hex_to_binary)
    assert (bytes(got) if got is not None else None) == expected


def test_null_marker_is_not_the_empty_text(spark):
    assert one(spark, "", V.marker_to_null) == ""
    assert one(spark, "\\N", V.marker_to_null) is None
    assert one(spark, "\\n", V.marker_to_null) == "\\n"


def test_csv_field(spark):
    assert one(spark, 'a"b,c', L.csv_field) == '"a""b,c"'
    assert one(spark, "plain", L.csv_field) == "plain"
    assert one(spark, None, L.csv_field) == "\\N"
    assert one(spark, "a|b", lambda c: L.csv_field(c, sep="|", quote="'")) == "'a|b'"


def test_undecodable_bytes_do_not_fail(spark):
    row = spark.createDataFrame([(bytearray(b"ok\xff\xff"),)], "v binary").select(V.decode_bytes(F.col("v"), "GBK"))
    assert row.first()[0].startswith("ok")
