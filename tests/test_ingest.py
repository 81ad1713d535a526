from __future__ import annotations

import glob
import os

import pytest

from ferrywright.functions.values import COMPACT_DATETIME
from ferrywright.operators import reconcile as R
from ferrywright.plans.load import Transforms
from ferrywright.plans.views import refresh_materialized
from ferrywright.sinks.tables import append_table, require_values, write_lake_table
from ferrywright.sources import jdbc
from ferrywright.sources.catalog import load_specs
from ferrywright.spec import ColumnSpec, TableSpec
from ferrywright.streaming.landing_stream import ingest_new_files, read_ingested
from showcase.transfer import database
from tests.test_files import put

TABLE = TableSpec(
    "s", "t", (ColumnSpec("k", "BIGINT", nullable=False), ColumnSpec("d", "TIMESTAMP")), dialect="postgres", primary_key=("k",)
)


@pytest.fixture
def ingest(spark, tmp_path):
    source = tmp_path / "s.t.csv"

    def run(name=None, content=""):
        if name:
            put(source, name, content)
        ingest_new_files(
            spark, str(source), TABLE, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"),
            Transforms(datetime_format=COMPACT_DATETIME),
        )
        good = sorted(r["k"] for r in read_ingested(spark, str(tmp_path / "good")).collect())
        return good, [tuple(r) for r in read_ingested(spark, str(tmp_path / "bad")).select("row_key", "reason").collect()]

    run.root = tmp_path
    return run


def test_each_file_is_taken_once(ingest):
    assert ingest("1.csv", "k,d\n1,19991231235959\n2,\\N\n") == ([1, 2], [])
    assert ingest() == ([1, 2], [])
    assert ingest("2.csv", "k,d\n3,19991331000000\n4\n5,\\N\n")[0] == [1, 2, 5]
    assert sorted(ingest()[1]) == [("", "CSV_SHAPE"), ("3", "CAST")]


def test_keys_are_unique_within_and_across_drops(ingest):
    assert ingest("1.csv", "k,d\n1,\\N\n1,\\N\n2,\\N\n") == ([1, 2], [("1", "DUP_PK")])
    good, bad = ingest("2.csv", "k,d\n2,\\N\n3,\\N\n")
    assert good == [1, 2, 3] and sorted(bad) == [("1", "DUP_PK"), ("2", "DUP_PK")]
    assert ingest() == (good, bad)


def test_a_new_checkpoint_needs_an_empty_target(ingest):
    ingest("1.csv", "k,d\n1,\\N\n")
    os.replace(ingest.root / "state", ingest.root / "old_state")
    with pytest.raises(ValueError, match="earlier checkpoint"):
        ingest("2.csv", "k,d\n2,\\N\n")


def test_a_repeated_batch_replaces_itself(ingest):
    ingest("1.csv", "k,d\n1,\\N\n")
    # The run died after writing and before its commit.
    for path in glob.glob(str(ingest.root / "state" / "commits" / "*")) + glob.glob(str(ingest.root / "state" / "commits" / ".*")):
        if os.path.isfile(path):
            os.remove(path)
    assert ingest()[0] == [1]


CATALOG = {
    "columns.csv": "TABLE_SCHEMA,TABLE_NAME,COLUMN_NAME,ORDINAL_POSITION,DATA_TYPE,DATA_LENGTH,DATA_PRECISION,DATA_SCALE,NULLABLE\n"
    "# a comment\nHR,EMP,NAME,2,VARCHAR2,10,,,YES\nHR,EMP,ID,1,NUMBER,22,4,0,NO\nHR,EMP,BOSS,3,NUMBER,22,4,0,YES\nHR,DEPT,ID,1,NUMBER,22,2,0,NO\n",
    "primary_keys.csv": "TABLE_SCHEMA,TABLE_NAME,CONSTRAINT_NAME,COLUMN_NAME,ORDINAL_POSITION\nHR,EMP,PK,ID,1\n",
    "foreign_keys.csv": "CONSTRAINT_NAME,TABLE_SCHEMA,TABLE_NAME,COLUMN_NAME,REF_SCHEMA,REF_TABLE,REF_COLUMN,DELETE_RULE\n"
    "FK,HR,EMP,BOSS,HR,EMP,ID,SET NULL\n",
    "indexes.csv": "TABLE_SCHEMA,TABLE_NAME,INDEX_NAME,COLUMN_NAME,ORDINAL_POSITION,INDEX_TYPE,UNIQUENESS\n"
    "HR,EMP,U,BOSS,2,BTREE,UNIQUE\nHR,EMP,U,NAME,1,BTREE,UNIQUE\nHR,EMP,I,NAME,1,BTREE,NONUNIQUE\n",
}


def test_catalog_files(spark, tmp_path):
    for name, content in CATALOG.items():
        put(tmp_path, name, content)
    specs = load_specs(spark, str(tmp_path))
    emp = specs["HR.EMP"]
    assert [c.name for c in emp.ordered()] == ["ID", "NAME", "BOSS"]
    assert emp.primary_key == ("ID",) and emp.unique_keys == (("NAME", "BOSS"),)
    assert emp.foreign_keys[0].ref_table == "HR.EMP" and emp.foreign_keys[0].delete_rule == "SET NULL"
    assert emp.column("name").length == 10 and not emp.column("id").nullable and emp.column("id").length == 0
    assert specs["HR.DEPT"].primary_key == ()


def test_catalog_needs_only_columns(spark, tmp_path):
    put(tmp_path, "columns.csv", CATALOG["columns.csv"])
    assert load_specs(spark, str(tmp_path))["HR.EMP"].foreign_keys == ()


def test_resume_adds_nothing_twice(spark, tmp_path):
    target = str(tmp_path / "t")
    source = spark.range(100)
    write_lake_table(source.filter("id < 40"), target)
    for _ in range(3):
        write_lake_table(R.remaining_rows(source, spark.read.parquet(target).cache(), ["id"]), target)
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == list(range(100))


def test_reload_keeps_other_partitions(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.range(10).selectExpr("id", "id % 2 AS p")
    write_lake_table(rows, target, ("p",))
    write_lake_table(rows.filter("p = 1").selectExpr("id + 100 AS id", "p"), target, ("p",), reload=True)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]


def test_materialised_view_is_replaced(spark, tmp_path):
    path = str(tmp_path / "mv")
    assert refresh_materialized(spark, "SELECT 1 AS a UNION ALL SELECT 2", path).count() == 2
    assert refresh_materialized(spark, "SELECT 3 AS a", path).count() == 1


def test_database_ranges(spark):
    db = database(spark)
    spark.createDataFrame([(None,), (1,), (2,), (1000,), (10**6,)], "k long").write.format("jdbc").options(
        **db.writer_options()
    ).option("dbtable", "gaps").save()
    ranges = jdbc.balanced_ranges(spark, db, "gaps", "k", 3)
    for df in (jdbc.scan_by_predicates(spark, db, "gaps", ranges), jdbc.scan_by_range(spark, db, "gaps", "k", 3)):
        assert df.rdd.getNumPartitions() > 1
        assert sorted((r[0] or 0) for r in df.collect()) == [0, 1, 2, 1000, 10**6]
    assert jdbc.text_ranges(db, "c", ["m", "d", "it's"]) == [
        "\"c\" < 'd' OR \"c\" IS NULL", "\"c\" >= 'd' AND \"c\" < 'it''s'", "\"c\" >= 'it''s' AND \"c\" < 'm'", "\"c\" >= 'm'",
    ]


def test_required_columns_are_created_not_null(spark):
    db = database(spark)
    kinds = ["BIGINT", "VARCHAR", "NUMERIC", "TIMESTAMP", "DATE", "BOOLEAN", "DOUBLE PRECISION"]
    spec = TableSpec("s", "strict", tuple(ColumnSpec(f"c{i}", k, length=9, nullable=False) for i, k in enumerate(kinds)), "postgres")
    row = spark.sql("SELECT 1L c0, 'x' c1, 1.5 c2, TIMESTAMP_NTZ'2001-01-01' c3, DATE'2001-01-01' c4, true c5, 1d c6")
    assert not any(f.nullable for f in require_values(row.selectExpr("*"), spec).schema.fields)
    append_table(row, db, "strict", spec=spec)
    with pytest.raises(Exception):
        row.selectExpr("nullif(c0, 1) c0", "c1", "c2", "c3", "c4", "c5", "c6").write.format("jdbc").options(
            **db.writer_options()
        ).option("dbtable", "strict").mode("append").save()
    with pytest.raises(Exception, match="NULL in s.strict.c1"):
        append_table(row.selectExpr("c0", "nullif(c1, 'x') c1", "c2", "c3", "c4", "c5", "c6"), db, "strict", spec=spec)
    assert jdbc.scan(spark, db, "strict").count() == 1


def test_pushdown_reaches_the_database(spark):
    db = database(spark)
    spark.range(50).selectExpr("id AS a", "id AS b").write.format("jdbc").options(**db.writer_options()).option(
        "dbtable", "wide"
    ).save()
    plan = jdbc.scan(spark, db, "wide", ["a"]).filter("a > 7")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,7)" in plan and "ReadSchema: struct<a:bigint>" in plan
