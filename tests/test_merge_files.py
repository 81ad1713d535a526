"""Copy-on-write merges: what changes, what stays, and what a dying merge leaves."""

from __future__ import annotations

import datetime

import pytest

from ferrywright.sinks import merge as M

SCHEMA = "a int, b string, v string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.createDataFrame([(i // 4, f"k{i % 4}", "old") for i in range(4000)], SCHEMA)
    M.create_files(rows, path, ["a", "b"], file_rows=100)
    return path


def names(spark, path):
    return {r.file for r in M.directory(spark, path).collect()}


def test_ranges_are_disjoint_and_only_touched_files_change(spark, table):
    listed = sorted(((tuple(r.low), tuple(r.high)) for r in M.directory(spark, table).collect()))
    assert len(listed) >= 40
    assert all(x[1] < y[0] for x, y in zip(listed, listed[1:]))
    before = names(spark, table)
    replaced = M.merge_files(spark.createDataFrame([(5, "k1", "new"), (5, "k1b", "more"), (990, "k0", "new")], SCHEMA), table, ["a", "b"])
    assert 1 <= len(replaced) <= 2
    after = names(spark, table)
    assert before - after == set(replaced) and len(after & before) == len(before) - len(replaced)
    expected = {(i // 4, f"k{i % 4}"): "old" for i in range(4000)} | {(5, "k1"): "new", (5, "k1b"): "more", (990, "k0"): "new"}
    assert rows_of(M.read_files(spark, table)) == sorted((*k, v) for k, v in expected.items())
    listed = sorted(((tuple(r.low), tuple(r.high)) for r in M.directory(spark, table).collect()))
    assert all(x[1] < y[0] for x, y in zip(listed, listed[1:]))


def test_rows_beyond_both_ends_many_rows_and_deletions(spark, table):
    new = [(-5, "first", "n"), (5000, "last", "n"), *((500, f"x{i:04d}", "n") for i in range(350))]
    gone = spark.createDataFrame([(i, f"k{k}") for i in range(100, 200) for k in range(4)] + [(77, "not there")], "a int, b string")
    M.merge_files(spark.createDataFrame(new, SCHEMA), table, ["a", "b"], deleted=gone, file_rows=100)
    expected = [(i // 4, f"k{i % 4}", "old") for i in range(4000) if not 100 <= i // 4 < 200] + new
    assert rows_of(M.read_files(spark, table)) == sorted(expected)
    assert max(r.rows for r in M.directory(spark, table).collect()) <= 100
    # Version 1 is still there for its readers.
    assert M.read_files(spark, table, version=1).count() == 4000


def test_dying_merge_leaves_the_old_table(spark, table, monkeypatch):
    old, version = rows_of(M.read_files(spark, table)), names(spark, table)

    def die(entries, path, number):
        entries.count()
        raise RuntimeError("killed")

    monkeypatch.setattr(M, "_publish", die)
    change = spark.createDataFrame([(5, "k1", "new")], SCHEMA)
    with pytest.raises(RuntimeError, match="killed"):
        M.merge_files(change, table, ["a", "b"])
    monkeypatch.undo()
    assert rows_of(M.read_files(spark, table)) == old and names(spark, table) == version
    assert len(M.unnamed_files(spark, table)) == 1
    M.merge_files(change, table, ["a", "b"])
    assert (5, "k1", "new") in rows_of(M.read_files(spark, table))


def test_second_of_two_merges_is_refused(spark, table, monkeypatch):
    publish = M._publish

    def overtaken(entries, path, number):
        entries = M.stage(entries)
        monkeypatch.setattr(M, "_publish", publish)
        M.merge_files(spark.createDataFrame([(900, "k1", "winner")], SCHEMA), table, ["a", "b"])
        publish(entries, path, number)

    monkeypatch.setattr(M, "_publish", overtaken)
    with pytest.raises(M.MergeConflict):
        M.merge_files(spark.createDataFrame([(5, "k1", "loser")], SCHEMA), table, ["a", "b"])
    assert {r[2] for r in rows_of(M.read_files(spark, table))} == {"old", "winner"}


def test_marker_without_a_name_stops_writers_only(spark, table, tmp_path):
    (tmp_path / "target" / "_versions" / f"{2:012d}").touch()
    assert M.read_files(spark, table).count() == 4000
    with pytest.raises(M.MergeConflict):
        M.merge_files(spark.createDataFrame([(5, "k1", "x")], SCHEMA), table, ["a", "b"])


@pytest.mark.parametrize("rows", [[(1, None, "x")], [(1, "z", "x"), (1, "z", "y")]])
def test_keys_must_be_there_once(spark, table, rows):
    with pytest.raises(ValueError, match="key"):
        M.merge_files(spark.createDataFrame(rows, SCHEMA), table, ["a", "b"])


def test_changed_and_deleted_key(spark, table):
    change = spark.createDataFrame([(1, "k1", "x")], SCHEMA)
    with pytest.raises(ValueError, match="both"):
        M.merge_files(change, table, ["a", "b"], deleted=change.select("a", "b"))


def test_empty_table_and_no_changes(spark, tmp_path):
    path = str(tmp_path / "days")
    none = spark.createDataFrame([], "d date, t timestamp_ntz, v int")
    M.create_files(none, path, ["d", "t"])
    assert M.read_files(spark, path).count() == 0
    assert M.merge_files(none, path, ["d", "t"]) == []
    at = datetime.datetime(2024, 1, 2, 3)
    some = spark.createDataFrame([(at.date(), at, 1), (at.date(), at + datetime.timedelta(1), 2)], "d date, t timestamp_ntz, v int")
    M.merge_files(some, path, ["d", "t"])
    assert M.read_files(spark, path).count() == 2
    assert M.merge_files(none, path, ["d", "t"]) == []
    with pytest.raises(ValueError, match="already"):
        M.create_files(some, path, ["d", "t"])
