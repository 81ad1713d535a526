"""What a run leaves behind, pages far down, and bytes that are no text."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ferrywright import ColumnSpec, ForeignKey, TableSpec
from ferrywright.functions.values import decode_or_keep
from ferrywright.plans.migrate import from_tables, migrate_tables
from ferrywright.session import run_scratch, scratch_path, scratch_root, stage
from ferrywright.sources import paging
from ferrywright.sources.selection import TableSelection
from ferrywright.streaming.landing_stream import ingest_new_files, read_ingested

UP = TableSpec("S", "UP", (ColumnSpec("id", "INTEGER"),), dialect="postgres", primary_key=("id",))
DOWN = TableSpec(
    "S", "DOWN", (ColumnSpec("id", "INTEGER"), ColumnSpec("up", "INTEGER")), dialect="postgres", primary_key=("id",),
    foreign_keys=(ForeignKey(("up",), "UP", ("id",)), ForeignKey(("id",), "DOWN", ("id",))),
)


def held(spark):
    root = f"{scratch_root(spark)}/ferrywright"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_run_deletes_its_working_tables(spark, tmp_path):
    rows = {"UP": [(1, None), (2, None), (2, None)], "DOWN": [(1, 1), (2, 5), (3, 2), (3, 2), (None, 1)]}
    read = from_tables(lambda t: spark.createDataFrame(rows[t.name], "id int, up int"))
    before = held(spark)
    out = str(tmp_path)
    counts = migrate_tables(
        [DOWN, UP], read, lambda df, t: df.write.parquet(f"{out}/{t.name}"), lambda df, t: df.write.parquet(f"{out}/{t.name}-bad")
    )
    assert held(spark) == before
    assert sorted((r.table, r.expected, r.actual, r.errors) for r in counts.collect()) == [("DOWN", 5, 2, 3), ("UP", 3, 2, 1)]
    assert spark.read.parquet(f"{out}/DOWN").count() == 2


def test_a_run_of_some_tables(spark):
    read = from_tables(lambda t: spark.createDataFrame([(1, 1)], "id int, up int"))
    seen = []
    counts = migrate_tables([DOWN, UP], read, lambda df, t: seen.append(t.name), lambda df, t: None, selection=TableSelection(include=("S.UP",)))
    assert seen == ["UP"] and counts.count() == 1
    nothing = migrate_tables([DOWN, UP], read, lambda df, t: seen.append(t.name), lambda df, t: None, selection=TableSelection(include=("X.*",)))
    assert seen == ["UP"] and nothing.count() == 0
    # A selected table needs those that it refers to.
    with pytest.raises(ValueError, match="refers to"):
        migrate_tables([DOWN, UP], read, lambda df, t: None, lambda df, t: None, selection=TableSelection(include=("S.DOWN",)))


def test_scratch_goes_even_if_the_run_fails_and_inner_runs_keep_to_theirs(spark):
    before = held(spark)
    with pytest.raises(RuntimeError), run_scratch(spark):
        stage(spark.range(3))
        with run_scratch(spark) as inner:
            frame = stage(spark.range(4))
        assert len(inner) == 1 and not os.path.exists(inner[0]) and frame is not None
        raise RuntimeError
    assert held(spark) == before
    outside = scratch_path(spark, "kept")
    spark.range(2).write.parquet(outside)
    assert len(held(spark)) == len(before) + 1


def test_a_batch_deletes_its_working_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id\n1\n1\nx\n")
    before = held(spark)
    ingest_new_files(spark, str(tmp_path / "in"), UP, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check"))
    assert held(spark) == before
    assert read_ingested(spark, str(tmp_path / "out")).count() == 1 and read_ingested(spark, str(tmp_path / "bad")).count() == 2


@pytest.mark.parametrize("offset", [0, 990, 3000])
def test_pages_far_down_are_numbered(spark, monkeypatch, offset):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"), F.lit("x").alias("v"))
    near = [tuple(r) for r in paging.offset_page(df, ["k"], 25, offset).collect()]
    monkeypatch.setattr(paging, "TOP_ROWS", 0)
    far = paging.offset_page(df, ["k"], 25, offset)
    assert [tuple(r) for r in far.collect()] == near and far.columns == df.columns


def test_bytes_that_are_no_text_are_kept(spark):
    rows = [(1, b"ok"), (2, b"a\xffb"), (3, "�".encode()), (4, None), (5, b""), (6, "�".encode() + b"\xc3")]
    df = spark.createDataFrame(rows, "id int, b binary").select("id", decode_or_keep(F.col("b"), "UTF-8").alias("d"))
    found = {r.id: (r.d.text, None if r.d.undecodable is None else bytes(r.d.undecodable)) for r in df.collect()}
    assert found[1] == ("ok", None) and found[3] == ("�", None) and found[4] == (None, None) and found[5] == ("", None)
    assert found[2] == ("a�b", b"a\xffb") and found[6][1] == rows[5][1]
    gbk = spark.createDataFrame([(1, "零件".encode("gbk")), (2, b"\x81\x20")], "id int, b binary").select("id", decode_or_keep(F.col("b"), "GBK").alias("d"))
    kept = {r.id: r.d.undecodable for r in gbk.collect()}
    assert kept[1] is None and bytes(kept[2]) == b"\x81\x20"
