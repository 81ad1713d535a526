"""What a load must refuse or keep: keys, references, lengths, typed values, identities."""

from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright import ColumnSpec, ForeignKey, TableSpec
from ferrywright.functions.literals import typed_literal
from ferrywright.operators.conform import target_overflow
from ferrywright.operators.numbering import fill_identity, replace_identity
from ferrywright.operators.reconcile import remaining_rows
from ferrywright.plans.load import load_table
from ferrywright.plans.migrate import by_reference, from_tables
from ferrywright.plans.load import Transforms
from ferrywright.operators.policy import ErrorPolicy
from ferrywright.session import stage
from ferrywright.sinks.tables import require_values
from ferrywright.spec import LogicalType

KEYED = TableSpec(
    "S", "T", (ColumnSpec("ID", "INTEGER"), ColumnSpec("U", "VARCHAR", length=10), ColumnSpec("B", "BYTEA", length=2)),
    dialect="postgres", primary_key=("ID",), unique_keys=(("U",),),
)


def codes(result):
    return sorted(r.reason for r in result.rejects.collect())


def test_keys_are_required_and_binary_lengths_checked(spark):
    df = spark.createDataFrame([("1", "a", "00ff"), (None, "b", None), ("2", "c", "00ff00")], "ID string, U string, B string")
    assert codes(load_table(df, KEYED, policy=ErrorPolicy("skip_row"))) == ["LENGTH", "NOT_NULL"]


def test_unique_keys_of_existing_rows(spark):
    df = spark.createDataFrame([("1", "a", None), ("2", "b", None)], "ID string, U string, B string")
    there = spark.createDataFrame([(9, "b")], "ID int, U string")
    assert codes(load_table(df, KEYED, policy=ErrorPolicy("skip_row"), existing=there)) == ["DUP_UNIQUE"]


def test_references_need_their_parents(spark):
    child = TableSpec("S", "C", (ColumnSpec("P", "INTEGER"),), dialect="postgres", foreign_keys=(ForeignKey(("P",), "S.T", ("ID",)),))
    df = spark.createDataFrame([("1",)], "P string")
    with pytest.raises(ValueError, match="S.T"):
        load_table(df, child)
    assert load_table(df, child, check_parents=False).accepted.count() == 1
    assert [t.name for t in by_reference([child, KEYED])] == ["T", "C"]
    back = TableSpec("S", "T", KEYED.columns, foreign_keys=(ForeignKey(("ID",), "S.C", ("P",)),))
    with pytest.raises(ValueError, match="circle"):
        by_reference([child, back])


def test_typed_values_stay_as_they_are(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    spec = TableSpec("S", "E", (ColumnSpec("ID", "INTEGER"), ColumnSpec("AT", "TIMESTAMP"), ColumnSpec("N", "TEXT")), dialect="postgres")
    source = spark.createDataFrame([(1, at, "\\N")], "ID int, AT timestamp_ntz, N string")
    read = from_tables(lambda table: source)
    assert read.typed
    result = load_table(read(spec), spec, Transforms(null_marker=None))
    assert [tuple(r) for r in result.accepted.collect()] == [(1, at, "\\N")]


def test_identity_continues_downwards(spark):
    df = spark.createDataFrame([(-1, 1), (-2, 2), (None, 3), (None, 4)], "id int, k int")
    assert sorted(r.id for r in fill_identity(df, "id", ["k"], increment=-1).collect()) == [-4, -3, -2, -1]
    empty = df.filter("id is null")
    assert sorted(r.id for r in fill_identity(empty, "id", ["k"], increment=5, start=100).collect()) == [100, 105]


def test_rows_without_a_key_load_once(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x"), (None, "y")], "id int, v string")
    target = spark.createDataFrame([(1, "a"), (None, "x")], "id int, v string")
    assert sorted(r.v for r in remaining_rows(source, target, ["id"]).collect()) == ["b", "y"]
    assert remaining_rows(source, source, ["id"]).count() == 0


def test_literals_keep_the_fraction(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5, 670000),), (datetime.datetime(2024, 1, 2),)], "t timestamp_ntz")
    out = [r[0] for r in df.select(typed_literal(F.col("t"), T.TimestampNTZType())).collect()]
    assert out == ["'2024-01-02 03:04:05.670000'", "'2024-01-02 00:00:00'"]


def test_lost_fractions_are_reported(spark):
    df = spark.createDataFrame([("12.75",), ("12",)], "s string").select(F.col("s").cast("decimal(10,2)").alias("c"))
    lost = target_overflow(F.col("c"), LogicalType("NUMERIC"), "duckdb")
    assert [r[0] for r in df.select(lost).collect()] == [True, False]


@pytest.mark.parametrize("kind", ["int", "long", "decimal(12,2)", "double", "date", "timestamp_ntz", "boolean", "string"])
def test_required_columns_are_not_nullable(spark, kind):
    df = spark.createDataFrame([("1",)], "s string").select(F.lit(None).cast(kind).alias("ID"))
    spec = TableSpec("S", "T", (ColumnSpec("ID", "INTEGER"),), dialect="postgres", primary_key=("ID",))
    assert not require_values(df, spec).schema["ID"].nullable


def test_rows_below_refused_rows_are_refused(spark):
    tree = TableSpec(
        "S", "N", (ColumnSpec("ID", "INTEGER"), ColumnSpec("UP", "INTEGER"), ColumnSpec("V", "VARCHAR", length=1)),
        dialect="postgres", primary_key=("ID",), foreign_keys=(ForeignKey(("UP",), "S.N", ("ID",)),),
    )
    rows = [("1", None, "x"), ("2", "1", "too long"), ("3", "2", "x"), ("4", "3", "x"), ("5", "1", "x"), ("6", "6", "x"), ("7", "90", "x")]
    df = spark.createDataFrame(rows, "ID string, UP string, V string")
    result = load_table(df, tree, policy=ErrorPolicy("skip_row"))
    assert sorted(r.ID for r in result.accepted.collect()) == [1, 5, 6]
    assert codes(result) == ["FK_ORPHAN", "FK_ORPHAN", "FK_ORPHAN", "LENGTH"]
    held = spark.createDataFrame([(90, None, "x")], "ID int, UP int, V string")
    result = load_table(df, tree, policy=ErrorPolicy("skip_row"), existing=held)
    assert sorted(r.ID for r in result.accepted.collect()) == [1, 5, 6, 7]


NINE = {
    "smallint": 1, "int": 2, "bigint": 3, "double": 1.5, "decimal(2,2)": decimal.Decimal("0.25"), "decimal(20,0)": decimal.Decimal(7),
    "date": datetime.date(2024, 1, 2), "timestamp_ntz": datetime.datetime(2024, 1, 2), "boolean": True, "binary": b"x", "string": "x", "float": 0.5,
}


@pytest.mark.parametrize("kind", NINE)
def test_null_of_any_kind_is_refused_not_replaced(spark, kind):
    spec = TableSpec("S", "N", (ColumnSpec("V", "TEXT", nullable=False), ColumnSpec("W", "TEXT")), dialect="postgres")
    schema = f"V {kind}, W {kind}"
    whole = require_values(spark.createDataFrame([(NINE[kind], None)], schema), spec)
    assert [f.nullable for f in whole.schema] == [False, True]
    assert [tuple(r) for r in whole.collect()] == [(NINE[kind], None)]
    # Rows out of a file, so that nothing is known of them when the plan is made.
    rows = stage(spark.createDataFrame([(NINE[kind], None), (None, None)], schema))
    with pytest.raises(Exception, match="NULL in S.N.V"):
        require_values(rows, spec).collect()


def test_fractions_of_typed_numbers_are_refused(spark):
    spec = TableSpec("S", "F", (ColumnSpec("A", "NUMBER", precision=4), ColumnSpec("B", "NUMBER", precision=9), ColumnSpec("C", "NUMBER", precision=4, scale=1)))
    rows = [(12.75, decimal.Decimal("12.9"), 1.25), (12.0, decimal.Decimal("13.0"), 1.25), (None, None, None), (-0.5, None, None), (float("nan"), None, None)]
    df = spark.createDataFrame(rows, "A double, B decimal(6,1), C double")
    result = load_table(df, spec, policy=ErrorPolicy("skip_row"))
    assert sorted((r.column, r.reason) for r in result.rejects.collect()) == [
        ("A", "CAST"), ("A", "PRECISION"), ("A", "PRECISION"), ("B", "PRECISION")
    ]
    assert result.accepted.count() == 2


def test_identities_count_downwards(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)], "k int, id long")
    ids = lambda frame: [r.id for r in frame.orderBy("k").collect()]
    assert ids(replace_identity(df, "id", ["k"], -1, -1)) == [-1, -2, -3, -4, -5]
    assert ids(replace_identity(df, "id", ["k"], 1, -1)) == [1, 0, -1, -2, -3]
    assert ids(replace_identity(df, "id", ["k"], -(2**63) + 1, -1))[:3] == [-(2**63) + 1, -(2**63), None]
    assert ids(fill_identity(df, "id", ["k"], increment=-3)) == [-3, -6, -9, -12, -15]


def test_references_are_found_without_case_and_in_the_own_schema(spark):
    dept = TableSpec("HR", "DEPT", (ColumnSpec("ID", "INTEGER"),), primary_key=("ID",))
    rows = {"DEPT": spark.createDataFrame([("1",)], "ID string"), "EMP": spark.createDataFrame([("1",), ("2",)], "D string")}
    for name in ("HR.DEPT", "hr.dept", "dept", "Dept"):
        emp = TableSpec("hr", "EMP", (ColumnSpec("D", "INTEGER"),), foreign_keys=(ForeignKey(("D",), name, ("ID",)),))
        assert [t.name for t in by_reference([emp, dept])] == ["DEPT", "EMP"]
        for given in ("HR.DEPT", "hr.dept"):
            result = load_table(rows["EMP"], emp, parents={given: rows["DEPT"].select(F.col("ID").cast("int"))})
            assert codes(result) == ["FK_ORPHAN"]
