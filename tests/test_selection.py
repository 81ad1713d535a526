from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ferrywright.sources.landing import split_landing_name
from ferrywright.sources.selection import TableSelection, scope_selection

EVERY = ("*",)


@pytest.mark.parametrize(
    "selection,schema,table,expected",
    [
        (TableSelection(EVERY), "SCOTT", "EMP", True),
        (TableSelection(("SCOTT.EMP",)), "SCOTT", "EMP", True),
        (TableSelection(("HR.DEPT",)), "SCOTT", "EMP", False),
        (TableSelection(EVERY, exclude_glob=("*_LOG",)), "SCOTT", "ERR_LOG", False),
        (TableSelection(EVERY, exclude_glob=("*_LOG",)), "SCOTT", "EMP", True),
        (TableSelection(EVERY, exclude_regex=(r"^BIN\$",)), "SCOTT", "BIN$abc123", False),
        (TableSelection(EVERY, exclude_schemas=("sys", "SYSTEM")), "SYS", "SOME_TABLE", False),
        (TableSelection(EVERY, exclude_tables=("SCOTT.TEMP_DATA",)), "SCOTT", "TEMP_DATA", False),
        (TableSelection(("SCOTT.*",)), "SCOTT", "EMP", True),
        (TableSelection(("HR.*",)), "SCOTT", "EMP", False),
        (TableSelection(()), "SCOTT", "EMP", True),
        (TableSelection(("EM?",)), "SCOTT", "EMP", True),
        (TableSelection(("E[MN]P",)), "SCOTT", "EMP", True),
        (TableSelection(("E.P",)), "SCOTT", "EMP", False),
        (scope_selection("schema:HR"), "SCOTT", "EMP", False),
        (scope_selection("table:SCOTT.EMP"), "SCOTT", "EMP", True),
        (scope_selection("table:EMP"), "HR", "EMP", True),
    ],
)
def test_selection(spark, selection, schema, table, expected):
    df = spark.createDataFrame([(schema, table)], "s string, t string")
    assert df.select(selection.predicate(F.col("s"), F.col("t"))).first()[0] is expected


@pytest.mark.parametrize(
    "path,expected",
    [
        ("file:/d/hr.emp.csv", ("hr", "emp")),
        ("file:/d/hr.emp.csv/part-00000-x-c000.csv", ("hr", "emp")),
        ("file:/d/web.logs.events.csv/part-00000.csv", ("web", "logs.events")),
        ("file:/d.x/nodot.csv", ("", "")),
    ],
)
def test_landing_names(spark, path, expected):
    schema, table = split_landing_name(F.col("p"))
    assert tuple(spark.createDataFrame([(path,)], "p string").select(schema, table).first()) == expected


def test_one_name_is_chosen_like_a_row_of_names(spark):
    names = [("HR", "EMP"), ("HR", "emp_old"), ("web", "logs.events"), ("Web", "x"), ("S", "a[1]")]
    choices = [
        TableSelection(), TableSelection(include=()), TableSelection(include=("HR.*", "x")), TableSelection(exclude_glob=("emp*", "web.*")),
        TableSelection(exclude_regex=("^lo", "EMP$")), TableSelection(exclude_schemas=("WEB",)), TableSelection(exclude_tables=("hr.EMP", "s.A[1]")),
        TableSelection(include=("a?1?", "*.EMP"), exclude_schemas=("hr",)),
    ]
    rows = spark.createDataFrame(names, "schema string, table string")
    for choice in choices:
        chosen = rows.filter(choice.predicate(F.col("schema"), F.col("table"))).collect()
        assert [n for n in names if choice.chooses(*n)] == [tuple(r) for r in chosen]
