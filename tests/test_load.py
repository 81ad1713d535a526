from __future__ import annotations

import datetime
import decimal
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ferrywright.functions.values import COMPACT_DATETIME
from ferrywright.operators import checks as C
from ferrywright.operators import policy as P
from ferrywright.operators import report as R
from ferrywright.plans.load import Transforms, load_table
from ferrywright.plans.migrate import from_tables, migrate_tables
from ferrywright.plans.views import well_paid
from ferrywright.spec import ColumnSpec, TableSpec
from tests.emp import DEPT, DEPT_ROWS, EMP, EMP_ROWS, text_frame

STEPS = Transforms(trim=True, datetime_format=COMPACT_DATETIME)


def load_emp(spark, rows=EMP_ROWS, policy=P.ErrorPolicy(), spec=EMP):
    dept = load_table(text_frame(spark, DEPT, DEPT_ROWS), DEPT, STEPS).accepted
    return load_table(text_frame(spark, spec, rows), spec, STEPS, policy, {"SCOTT.DEPT": dept})


def counts(result):
    return tuple(result.counts.select("expected", "actual", "skipped", "errors").first())


def reasons(result):
    return {(r["row_key"], r["reason"], r["column"], r["value"]) for r in result.rejects.collect()}


def test_employees_arrive_whole(spark):
    result = load_emp(spark)
    assert counts(result) == (14, 14, 0, 0)
    assert result.rejects.count() == 0
    smith = result.accepted.filter("EMPNO = 7369").first()
    assert smith["HIREDATE"] == datetime.datetime(1980, 12, 17)
    assert smith["SAL"] == decimal.Decimal("800.00") and smith["COMM"] is None
    # Zero is a value.
    assert result.accepted.filter("ENAME = 'TURNER'").first()["COMM"] == 0
    assert R.with_status(result.counts).first()["status"] == "SUCCESS"


BAD_ROWS = [
    ("7369", "AGAIN", "CLERK", "7902", "19801217000000", "800", "\\N", "20"),
    ("8001", "NODEPT", "CLERK", "7902", "19801217000000", "800", "\\N", "99"),
    ("8002", "NOBOSS", "CLERK", "1", "19801217000000", "800", "\\N", "20"),
    ("8003", "TOOLONGANAME", "CLERK", "7902", "19811399000000", "123456.00", "none", "\\N"),
    ("\\N", "NOKEY", "CLERK", "7902", "19801217000000", "800", "\\N", "20"),
    ("12345", "WIDEKEY", "CLERK", "7902", "19801217000000", "800", "\\N", "20"),
]


def test_every_reason_is_named(spark):
    result = load_emp(spark, EMP_ROWS + BAD_ROWS)
    assert counts(result) == (20, 14, 6, 6)
    assert reasons(result) == {
        ("7369", "DUP_PK", "EMPNO", "7369"),
        ("8001", "FK_ORPHAN", "DEPTNO", "99"),
        ("8002", "FK_ORPHAN", "MGR", "1"),
        ("8003", "LENGTH", "ENAME", "TOOLONGANAME"),
        ("8003", "CAST", "HIREDATE", "1981-13-99 00:00:00"),
        ("8003", "PRECISION", "SAL", "123456.00"),
        ("8003", "CAST", "COMM", "none"),
        ("8003", "NOT_NULL", "DEPTNO", None),
        ("", "NOT_NULL", "EMPNO", None),
        ("12345", "PRECISION", "EMPNO", "12345"),
    }
    assert result.accepted.filter("EMPNO = 7369").first()["ENAME"] == "SMITH"


def test_a_refused_row_does_not_take_its_key(spark):
    rows = [("8001", "TOOLONGANAME", "CLERK", "7902", "19801217000000", "1", "\\N", "20")] + [
        ("8001", "GOOD", "CLERK", "7902", "19801217000000", "1", "\\N", "20")
    ]
    result = load_emp(spark, EMP_ROWS + rows)
    assert result.accepted.filter("EMPNO = 8001").first()["ENAME"] == "GOOD"


def test_unique_index_lets_nulls_pass_and_refuses_repeats(spark):
    spec = replace(EMP, unique_keys=(("MGR",),), foreign_keys=())
    result = load_emp(spark, spec=spec)
    managers = {r[3] for r in EMP_ROWS}
    assert counts(result)[1] == len(managers)
    assert {r["reason"] for r in result.rejects.collect()} == {"DUP_UNIQUE"}


def test_exact_copies_count_once(spark):
    result = load_emp(spark, EMP_ROWS * 50)
    assert counts(result) == (700, 14, 686, 686)


def test_an_append_meets_existing_rows(spark):
    before = spark.createDataFrame([(7369,), (7499,)], "EMPNO int")
    dept = text_frame(spark, DEPT, DEPT_ROWS)
    result = load_table(text_frame(spark, EMP, EMP_ROWS), EMP, STEPS, parents={"SCOTT.DEPT": dept}, existing=before)
    assert counts(result) == (14, 12, 2, 2)
    assert {(k, r) for k, r, _, _ in reasons(result)} == {("7369", "DUP_PK"), ("7499", "DUP_PK")}


def test_a_run_over_typed_tables(spark, tmp_path):
    emp = load_emp(spark).accepted
    dept = load_table(text_frame(spark, DEPT, DEPT_ROWS), DEPT, STEPS).accepted
    tables = {"EMP": emp, "DEPT": dept.filter("DEPTNO <> 10")}
    out = migrate_tables(
        [DEPT, EMP],
        from_tables(lambda t: tables[t.name]),
        lambda rows, t: rows.write.parquet(str(tmp_path / t.name)),
        lambda rows, t: rows.write.parquet(str(tmp_path / f"{t.name}.bad")),
        STEPS,
    )
    got = {r["table"]: (r["expected"], r["actual"]) for r in out.collect()}
    # Everyone in department 10 is refused.
    assert got == {"DEPT": (3, 3), "EMP": (14, 11)}
    assert spark.read.parquet(str(tmp_path / "EMP")).count() == 11
    assert spark.read.parquet(str(tmp_path / "EMP.bad")).select("row_key").distinct().count() == 3


SIMPLE = TableSpec(
    "s",
    "t",
    (ColumnSpec("k", "NUMBER", precision=9, nullable=False), ColumnSpec("v", "NUMBER", precision=4)),
    primary_key=("k",),
)


def simulate(rows, policy):
    """The load row by row, in key order with missing keys first."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, int(r[0] or 0)))
    actual = skipped = errors = 0
    seen: set[str] = set()
    for key, value in ordered:
        good = key is not None and key not in seen and (value is None or value.isdigit())
        if good:
            seen.add(key)
            actual += 1
            continue
        errors += 1
        if policy.kind == "stop":
            break
        if policy.kind == "skip_row":
            skipped += 1
            if policy.max_errors and errors >= policy.max_errors:
                break
    return len(rows), actual, skipped, errors


@pytest.mark.parametrize(
    "policy",
    [P.ErrorPolicy("stop"), P.ErrorPolicy("skip_row"), P.ErrorPolicy("skip_row", 3), P.ErrorPolicy("skip_row", 99),
     P.ErrorPolicy("log_only")],
    ids=lambda p: f"{p.kind}-{p.max_errors}",
)
@pytest.mark.parametrize("missing_key", [False, True])
def test_policies_against_a_row_loop(spark, policy, missing_key):
    rows = [(str(k), "x" if k in (17, 40, 41, 77) else str(k)) for k in range(100)]
    if missing_key:
        rows.append((None, "5"))
    text = spark.createDataFrame(rows, "k string, v string").repartition(5)
    result = load_table(text, SIMPLE, Transforms(), policy)
    expected = simulate(rows, policy)
    assert counts(result) == expected
    assert result.accepted.count() == expected[1]
    assert result.rejects.select("row_key").distinct().count() == expected[3]


def test_policy_names_are_checked():
    with pytest.raises(ValueError):
        P.ErrorPolicy("ignore")


def test_null_steps_and_booleans(spark):
    spec = TableSpec(
        "s", "t",
        (ColumnSpec("a", "VARCHAR", length=9), ColumnSpec("b", "BOOLEAN"), ColumnSpec("c", "DATE"), ColumnSpec("d", "BYTEA"),
         ColumnSpec("n", "BIGINT")),
        dialect="postgres",
    )
    steps = Transforms(
        null_if=("none",), null_words=("N/A",), null_words_case_sensitive=False, null_regex="^-+$", trim=True,
        datetime_format=COMPACT_DATETIME, datetime_fallbacks=("dd/MM/yyyy",), boolean_words={"si": True},
        empty_is_null=True,
    )
    rows = [
        (" x ", "si", "24/12/1999", "0aff", "19991224000000"),
        ("none", "true", "19991224101112", "\\N", "1"),
        ("n/a", "\\N", "\\N", "", "2"),
        ("---", "f", "1999-12-24", "zz", "3"),
        (" ", "f", "someday", "00", "4"),
    ]
    text = spark.createDataFrame(rows, "a string, b string, c string, d string, n string")
    result = load_table(text, spec, steps)
    got = {r["n"]: (r["a"], r["b"], str(r["c"]), r["d"] and bytes(r["d"]).hex()) for r in result.accepted.collect()}
    day = "1999-12-24"
    assert got[19991224000000] == ("x", True, day, "0aff")
    assert got[1] == (None, True, day, None)
    assert got[2][0] is None and got[2][1] is None
    assert {(r["reason"], r["column"]) for r in result.rejects.collect()} == {("BAD_HEX", "d"), ("CAST", "c")}


def test_numeric_booleans_follow_the_target(spark):
    spec = TableSpec("s", "t", (ColumnSpec("b", "BOOLEAN"),), dialect="postgres")
    text = spark.createDataFrame([("yes",), ("N",), ("?",)], "b string")
    step = lambda target: [
        r[0] for r in text.select(Transforms(target=target).apply(F.col("b"), spec.columns[0], spec)).collect()
    ]
    assert step("mysql") == ["1", "0", "?"]
    assert step("postgres") == ["yes", "N", "?"]


def test_well_paid_view(spark):
    emp = load_emp(spark).accepted
    dept = load_table(text_frame(spark, DEPT, DEPT_ROWS), DEPT, STEPS).accepted
    view = well_paid(emp, dept)
    assert view.count() == 12
    assert view.filter("ename = 'KING'").first()["dname"] == "ACCOUNTING"


def test_profile_against_declaration(spark):
    emp = load_emp(spark).accepted
    declared = spark.createDataFrame(
        [("EMP", "ENAME", 5, 0, True), ("EMP", "SAL", 0, 5, True), ("EMP", "MGR", 0, 0, False)],
        "table string, column string, length int, precision int, nullable boolean",
    )
    got = {r["column"]: r for r in R.profile_against(R.column_profile(emp, "EMP"), declared).collect()}
    assert got["ENAME"]["too_long"] and got["ENAME"]["max_length"] == 6
    assert got["SAL"]["too_wide"] and got["MGR"]["null_in_required"]


def test_report_document(spark):
    result = load_emp(spark, EMP_ROWS + BAD_ROWS)
    dept = load_table(text_frame(spark, DEPT, DEPT_ROWS), DEPT, STEPS)
    both = R.union_all([result.counts, dept.counts])
    doc = R.report_document(both, "oracle", "postgres").first()
    assert [t["table"] for t in doc["tables"]] == ["DEPT", "EMP"]
    assert (doc["total_expected"], doc["total_actual"], doc["status"]) == (24, 18, "PARTIAL")
    totals = R.report_totals(both).first()
    assert (totals["tables"], totals["failed_tables"], totals["errors"]) == (2, 1, 6)


def test_checks_stay_in_one_stage(spark):
    checked = C.check_rows(text_frame(spark, EMP, EMP_ROWS), EMP)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stored_findings_are_joined_once(spark):
    table = TableSpec("S", "t", (ColumnSpec("id", "INTEGER"),), dialect="postgres", primary_key=("id",))
    text = spark.createDataFrame([("1",), ("1",), ("2",), ("x",)], "id string")
    found = load_table(text, table, store=True)
    assert "Join" not in found.checked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in found.accepted.collect()) == [1, 2] and found.rejects.count() == 2
