from __future__ import annotations

import pytest
from pyspark.sql import types as T

from ferrywright.dialects import (
    NameRule, ParamRule, TypeRules, family, fold_identifier, logical_type, quote_identifier, split_type,
    takes_numeric_booleans,
)
from ferrywright.operators.conform import create_table_column_types
from ferrywright.spec import ColumnSpec, LogicalType, TableSpec, header_spec, spark_type


@pytest.mark.parametrize(
    "dialect,name,args,base",
    [
        ("oracle", "VARCHAR2", (10, 0, 0), "VARCHAR"), ("oracle", "NUMBER", (0, 4, 0), "SMALLINT"),
        ("oracle", "NUMBER", (0, 9, 0), "INT"), ("oracle", "NUMBER", (0, 18, 0), "BIGINT"),
        ("oracle", "NUMBER", (0, 19, 0), "NUMERIC"), ("oracle", "NUMBER", (0, 7, 2), "NUMERIC"),
        ("oracle", "NUMBER", (0, 0, 0), "NUMERIC"), ("oracle", "DATE", (), "DATETIME"),
        ("oracle", "TIMESTAMP(6) WITH TIME ZONE", (), "TIMESTAMPTZ"), ("oracle", "LONG RAW", (), "BLOB"),
        ("postgres", "jsonb", (), "JSON"), ("postgres", "SERIAL8", (), "BIGINT"), ("postgres", "bytea", (), "BLOB"),
        ("mysql", "TINYINT", (), "SMALLINT"), ("mysql", "YEAR", (), "SMALLINT"), ("mysql", "LONGTEXT", (), "CLOB"),
        ("sqlite3", "BIGINT", (), "INT"), ("sqlite3", "REAL", (), "FLOAT"), ("sqlite3", "anything", (), "VARCHAR"),
        ("duckdb", "HUGEINT", (), "NUMERIC"), ("duckdb", "TIMESTAMP_MS", (), "TIMESTAMP"),
        ("duckdb", "INTERVAL DAY", (), "INTERVAL"), ("goldendb", "MEDIUMINT", (), "INT"),
        ("oceanbase-oracle", "NUMBER", (0, 4, 0), "SMALLINT"), ("opengaussdb", "INT4", (), "INT"),
        ("panweidb-mysql", "SET", (), "VARCHAR"),
    ],
)
def test_logical_type(dialect, name, args, base):
    assert logical_type(dialect, name, *args).base == base


def test_implied_lengths():
    assert logical_type("postgres", "UUID").length == 36
    assert logical_type("mysql", "SET").length == 255


def test_unknown_dialect():
    with pytest.raises(ValueError):
        family("dbase")


def test_spark_types():
    assert spark_type(LogicalType("NUMERIC")) == T.DecimalType(38, 10)
    assert spark_type(LogicalType("NUMERIC", precision=65, scale=30)) == T.DecimalType(38, 30)
    assert spark_type(LogicalType("TIMESTAMP")) == T.TimestampNTZType()


def test_casing_and_quotes():
    assert fold_identifier("Emp", "oracle") == "EMP"
    assert fold_identifier("Emp", "opengaussdb") == "emp"
    assert fold_identifier("Emp", "mysql") == "Emp"
    assert quote_identifier("t", "goldendb") == "`t`"
    assert quote_identifier('a"b', "postgres") == '"a""b"'
    assert quote_identifier("t", "postgres", quote=False) == "t"


def test_numeric_booleans():
    wanted = {"mysql": True, "oracle": True, "goldendb": True, "oceanbase-oracle": True, "postgres": False,
              "panweidb-mysql": False, "panweidb-oracle": False, "sqlite3": False}
    assert {d: takes_numeric_booleans(d) for d in wanted} == wanted


FORWARD = TypeRules(
    "postgres",
    exact={"VARCHAR2": "VARCHAR", "CHAR": "CHAR", "NUMBER": "NUMERIC", "DATE": "TIMESTAMP", "CLOB": "TEXT"},
    parameterized={
        "NUMBER": [
            ParamRule("SMALLINT", scale=0, max_precision=4),
            ParamRule("INTEGER", scale=0, max_precision=9),
            ParamRule("BIGINT", scale=0, max_precision=18),
            ParamRule("NUMERIC(%p,%s)", scale_gt=0),
            ParamRule("NUMERIC"),
        ]
    },
    by_name=[NameRule(".*_FLAG$", "BOOLEAN", "CHAR", 1), NameRule(".*_TIME$|.*_DATE$", "TIMESTAMP", "DATE")],
)


@pytest.mark.parametrize(
    "column,target",
    [
        (ColumnSpec("c", "VARCHAR2", length=100), "VARCHAR"),
        (ColumnSpec("c", "NUMBER", precision=4), "SMALLINT"),
        (ColumnSpec("c", "NUMBER", precision=9), "INTEGER"),
        (ColumnSpec("c", "NUMBER", precision=10), "BIGINT"),
        (ColumnSpec("c", "NUMBER", precision=25), "NUMERIC"),
        (ColumnSpec("c", "NUMBER", precision=10, scale=2), "NUMERIC(10,2)"),
        (ColumnSpec("CREATED_TIME", "DATE"), "TIMESTAMP"),
        (ColumnSpec("IS_FLAG", "CHAR", length=1), "BOOLEAN"),
        (ColumnSpec("IS_FLAG", "CHAR", length=2), "CHAR"),
        (ColumnSpec("c", "UNKNOWN_TYPE", length=255), "UNKNOWN_TYPE"),
    ],
)
def test_rules(column, target):
    assert FORWARD.resolve(column) == target


def test_reverse_rules_and_placeholders():
    rules = TypeRules("oracle", exact={"BOOLEAN": "NUMBER(1)", "TEXT": "CLOB", "VARCHAR": "VARCHAR2(%l)"})
    assert rules.map_type(ColumnSpec("c", "BOOLEAN")) == "NUMBER(1)"
    assert rules.map_type(ColumnSpec("c", "TEXT")) == "CLOB"
    assert rules.map_type(ColumnSpec("c", "varchar", length=7)) == "VARCHAR2(7)"
    assert rules.map_type(ColumnSpec("c", "VARCHAR")) == "VARCHAR2"


def test_rules_retype_a_table():
    table = TableSpec("s", "t", (ColumnSpec("a", "NUMBER", precision=7, scale=2), ColumnSpec("b", "VARCHAR2", length=9)))
    a, b = FORWARD.apply(table).columns
    assert (a.type_name, a.precision, a.scale) == ("NUMERIC", 7, 2)
    assert b.type_name == "VARCHAR"


def test_split_type():
    assert split_type("decimal( 7 , 2 )") == ("DECIMAL", [7, 2])
    assert split_type("TIMESTAMP WITH TIME ZONE") == ("TIMESTAMP WITH TIME ZONE", [])


def test_created_types():
    table = TableSpec(
        "s", "t",
        (
            ColumnSpec("a", "NUMBER", precision=7, scale=2), ColumnSpec("b", "character  varying", length=9),
            ColumnSpec("c", "BOOLEAN"), ColumnSpec("d", "INTEGER"), ColumnSpec("e", "VARCHAR2"), ColumnSpec("f", "NUMBER", precision=5),
        ),
    )
    assert create_table_column_types(table, "mysql") == (
        "a DECIMAL(7,2), b VARCHAR(9), c TINYINT, d INTEGER, e VARCHAR(255), f DECIMAL(5)"
    )
    assert create_table_column_types(table, "oracle") == (
        "a DECIMAL(7,2), b VARCHAR(9), c DECIMAL(1), d DECIMAL(10), f DECIMAL(5)"
    )
    assert create_table_column_types(table, "postgres") == "a DECIMAL(7,2), b VARCHAR(9), f DECIMAL(5)"


def test_specs():
    with pytest.raises(ValueError):
        TableSpec("", "t", ())
    with pytest.raises(ValueError):
        TableSpec("s", "t", (ColumnSpec("a", "INT"), ColumnSpec("A", "INT")))
    spec = header_spec("S", "T", ["X", "Y"])
    assert spec.landing_name == "s.t.csv"
    assert spec.column("y").ordinal == 2 and spec.column("y").nullable
    with pytest.raises(KeyError):
        spec.column("z")
