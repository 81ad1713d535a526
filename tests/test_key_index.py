"""Batches that find their duplicates in buckets of keys."""

from __future__ import annotations

import re

import pytest

from ferrywright import ColumnSpec, TableSpec
from ferrywright.operators.checks import mark_existing, no_reasons, REASONS
from ferrywright.streaming.key_index import indexes
from ferrywright.streaming.landing_stream import ingest_new_files, read_ingested

ROWS = TableSpec(
    "S", "R", (ColumnSpec("id", "BIGINT"), ColumnSpec("part", "INTEGER"), ColumnSpec("code", "VARCHAR", length=9)),
    dialect="postgres", primary_key=("id", "part"), unique_keys=(("code",),),
)


@pytest.fixture
def run(spark, tmp_path):
    for name in ("in", "keys"):
        (tmp_path / name).mkdir()

    def land(name, lines, index=True):
        (tmp_path / "in" / f"{name}.csv").write_text("id,part,code\n" + "".join(f"{x}\n" for x in lines))
        found = indexes(str(tmp_path / "keys"), ROWS, 8) if index else ()
        ingest_new_files(spark, str(tmp_path / "in"), ROWS, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check"), index=found)
        rows = read_ingested(spark, str(tmp_path / "out")).collect()
        return sorted((r.id, r.part) for r in rows), sorted((r.row_key, r.reason) for r in read_ingested(spark, str(tmp_path / "bad")).collect())

    land.path = str(tmp_path / "keys")
    return land


def test_keys_of_earlier_batches(spark, run):
    assert run("one", ["1,1,a", "2,1,b", "3,1,\\N"]) == ([(1, 1), (2, 1), (3, 1)], [])
    rows, bad = run("two", ["1,1,x", "1,2,a", "4,1,b", "5,1,\\N", "6,1,c", "6,1,d"])
    assert rows == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1)]
    assert bad == [("1|1", "DUP_PK"), ("1|2", "DUP_UNIQUE"), ("4|1", "DUP_UNIQUE"), ("6|1", "DUP_PK")]
    # A new session knows nothing of the tables in the catalog.
    for index in indexes(run.path, ROWS, 8):
        spark.sql(f"DROP TABLE {index.name}")
    rows, bad = run("three", ["6,1,z", "7,1,c", "7,2,e"])
    assert rows[-1] == (7, 2) and bad[-2:] == [("6|1", "DUP_PK"), ("7|1", "DUP_UNIQUE")]


def test_a_repeated_batch_does_not_collide_with_itself(spark, run):
    run("one", ["1,1,a"])
    index = indexes(run.path, ROWS, 8)[0]
    rows = spark.createDataFrame([(1, 1), (9, 9)], "id long, part int")
    for _ in range(2):
        index.append(rows.filter("id = 9"), 5)
    assert sorted(r.id for r in index.held(spark, 5).collect()) == [1]
    assert {r.id for r in index.held(spark, 6).collect()} == {1, 9}


def test_an_index_must_be_there_from_the_start(run):
    run("one", ["1,1,a"], index=False)
    import shutil

    shutil.rmtree(run.path)
    with pytest.raises(ValueError, match="does not know"):
        run("two", ["2,1,b"])


def test_the_target_side_is_not_exchanged(spark, run, always_shuffle):
    run("one", [f"{i},1,c{i}" for i in range(300)])
    index = indexes(run.path, ROWS, 8)[0]
    arriving = spark.createDataFrame([(1, 1), (1, 1), (900, 1)], "id long, part int")
    taken = arriving.groupBy("id", "part").count().join(index.held(spark, 99), ["id", "part"], "left_semi")
    assert [(r.id, r["count"]) for r in taken.collect()] == [(1, 2)]
    plan = taken._jdf.queryExecution().executedPlan().toString()
    scan = plan[: re.search(r"FileScan parquet [^\n]*ferrywright_keys|FileScan parquet", plan).start()].rsplit("Join", 1)[1]
    last = scan.rstrip().splitlines()[-5:]
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in last)
    marked = mark_existing(arriving.withColumn(REASONS, no_reasons()), index.held(spark, 99), ["id", "part"])
    assert sorted(len(r[REASONS]) for r in marked.collect()) == [0, 1, 1]
