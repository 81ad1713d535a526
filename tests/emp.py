"""The classic employee tables, as specs and as landing text."""

from __future__ import annotations

from ferrywright.spec import ColumnSpec, ForeignKey, TableSpec

EMP = TableSpec(
    "SCOTT",
    "EMP",
    (
        ColumnSpec("EMPNO", "NUMBER", precision=4, nullable=False, ordinal=1),
        ColumnSpec("ENAME", "VARCHAR2", length=10, ordinal=2),
        ColumnSpec("JOB", "VARCHAR2", length=9, ordinal=3),
        ColumnSpec("MGR", "NUMBER", precision=4, ordinal=4),
        ColumnSpec("HIREDATE", "DATE", ordinal=5),
        ColumnSpec("SAL", "NUMBER", precision=7, scale=2, ordinal=6),
        ColumnSpec("COMM", "NUMBER", precision=7, scale=2, ordinal=7),
        ColumnSpec("DEPTNO", "NUMBER", precision=2, nullable=False, ordinal=8),
    ),
    primary_key=("EMPNO",),
    foreign_keys=(
        ForeignKey(("DEPTNO",), "SCOTT.DEPT", ("DEPTNO",), "CASCADE"),
        ForeignKey(("MGR",), "SCOTT.EMP", ("EMPNO",), "SET NULL"),
    ),
)
DEPT = TableSpec(
    "SCOTT",
    "DEPT",
    (
        ColumnSpec("DEPTNO", "NUMBER", precision=2, nullable=False, ordinal=1),
        ColumnSpec("DNAME", "VARCHAR2", length=14, ordinal=2),
        ColumnSpec("LOC", "VARCHAR2", length=13, ordinal=3),
    ),
    primary_key=("DEPTNO",),
)
NULL = "\\N"
EMP_ROWS = [
    ("7369", "SMITH", "CLERK", "7902", "19801217000000", "800", NULL, "20"),
    ("7499", "ALLEN", "SALESMAN", "7698", "19810220000000", "1600", "300", "30"),
    ("7521", "WARD", "SALESMAN", "7698", "19810222000000", "1250", "500", "30"),
    ("7566", "JONES", "MANAGER", "7839", "19810402000000", "2975", NULL, "20"),
    ("7654", "MARTIN", "SALESMAN", "7698", "19810928000000", "1250", "1400", "30"),
    ("7698", "BLAKE", "MANAGER", "7839", "19810501000000", "2850", NULL, "30"),
    ("7782", "CLARK", "MANAGER", "7839", "19810609000000", "2450", NULL, "10"),
    ("7788", "SCOTT", "ANALYST", "7566", "19870419000000", "3000", NULL, "20"),
    ("7839", "KING", "PRESIDENT", NULL, "19811117000000", "5000", NULL, "10"),
    ("7844", "TURNER", "SALESMAN", "7698", "19810908000000", "1500", "0", "30"),
    ("7876", "ADAMS", "CLERK", "7788", "19870523000000", "1100", NULL, "20"),
    ("7900", "JAMES", "CLERK", "7698", "19811203000000", "950", NULL, "30"),
    ("7902", "FORD", "ANALYST", "7566", "19811203000000", "3000", NULL, "20"),
    ("7934", "MILLER", "CLERK", "7782", "19820123000000", "1300", NULL, "10"),
]
DEPT_ROWS = [
    ("10", "ACCOUNTING", "NEW YORK"),
    ("20", "RESEARCH", "DALLAS"),
    ("30", "SALES", "CHICAGO"),
    ("40", "OPERATIONS", "BOSTON"),
]


def text_frame(spark, spec: TableSpec, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c.name} string" for c in spec.ordered()))
