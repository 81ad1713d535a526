"""Digest trees, collision bitmaps and observed counts."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ferrywright.operators import checks as C
from ferrywright.operators import digest_tree as D
from ferrywright.operators import policy as P
from ferrywright.operators.collisions import crowded_bitmaps, duplicates_by_bitmap
from ferrywright.operators.reconcile import differing_keys


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def trees(tmp_path, source, target, keys, columns=None, width=8):
    for name, side in (("source", source), ("target", target)):
        D.build_tree(side, str(tmp_path / name), keys, columns, width)
    return str(tmp_path / "source"), str(tmp_path / "target")


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,0)", "date", "timestamp", "timestamp_ntz"])
def test_tree_finds_what_the_full_comparison_finds(spark, tmp_path, kind):
    rng = random.Random(kind)
    place = {
        "bigint": lambda i: i * 3 - 4000,
        "decimal(20,0)": lambda i: __import__("decimal").Decimal(10**15 + 7 * i),
        "date": lambda i: datetime.date(1969, 1, 1) + datetime.timedelta(i),
        "timestamp": lambda i: datetime.datetime(1969, 12, 31) + datetime.timedelta(seconds=40 * i),
        "timestamp_ntz": lambda i: datetime.datetime(1969, 12, 31, 1) + datetime.timedelta(seconds=40 * i),
    }[kind]
    rows = [(place(i), f"s{i % 3}") for i in range(3000)] + [(None, "a"), (None, "b")]
    lost = set(rng.sample(range(3000), 9)) | set(range(700, 760))
    schema = f"k {kind}, s string"
    source = spark.createDataFrame(rows, schema)
    target = spark.createDataFrame([r for i, r in enumerate(rows) if i not in lost and r != (None, "b")] + [(place(9999), "x")], schema)
    paths = trees(tmp_path, source, target, ["k", "s"])
    expected = rows_of(differing_keys(source, target, ["k", "s"]))
    assert len(expected) == len(lost) + 2
    assert rows_of(D.reconcile_tree(source, target, *paths, ["k", "s"], width=8)) == expected


def test_rows_read_grow_with_the_differences(spark, tmp_path):
    source = spark.range(20_000).select(F.col("id").alias("k"))
    for lost, most in (([], 0), ([17], 16), ([17, 9000, 19_999], 48), (list(range(512, 640)), 128)):
        target = source.filter(~F.col("k").isin(lost)) if lost else source
        paths = trees(tmp_path / str(len(lost)), source, target, ["k"], width=16)
        leaves = D.differing_leaves(spark, *paths)
        assert D.rows_of_leaves(source, leaves, "k", 16).count() <= most
        assert rows_of(D.reconcile_tree(source, target, *paths, ["k"], width=16)) == [(k, "target") for k in sorted(lost, key=repr)] or len(lost) > 1
        assert D.reconcile_tree(source, target, *paths, ["k"], width=16).count() == len(lost)


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).select(F.col("id").alias("k")).write.parquet(path)
    table = spark.read.parquet(path)
    leaves = spark.createDataFrame([(3,), (4,), (200,)], "node long")
    plan = D.rows_of_leaves(table, leaves, "k", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(" in plan


def test_ranges_are_drawn_together_and_many_leaves_joined(spark, tmp_path, monkeypatch):
    assert D._spans([1, 2, 3, 7, 8, 20]) == [(1, 3), (7, 8), (20, 20)]
    monkeypatch.setattr(D, "MOST_RANGES", 2)
    assert D._spans([1, 2, 3, 7, 8, 20]) == [(1, 8), (20, 20)]
    assert D._spans([]) == [] and D._spans([5]) == [(5, 5)]
    source = spark.range(900).select(F.col("id").alias("k"))
    target = source.filter("k % 50 <> 3")
    paths = trees(tmp_path, source, target, ["k"])
    for most in (10_000, 3):
        monkeypatch.setattr(D, "MOST_LEAVES", most)
        assert rows_of(D.reconcile_tree(source, target, *paths, ["k"], width=8)) == rows_of(differing_keys(source, target, ["k"]))


def test_changed_rows_copies_and_empty_tables(spark, tmp_path):
    source = spark.createDataFrame([(i, i % 7, "x") for i in range(500)] + [(3, 3, "twice")], "k int, n int, s string")
    target = source.withColumn("n", F.when(F.col("k").isin(5, 444), -1).otherwise(F.col("n"))).filter("s <> 'twice' and k <> 8")
    paths = trees(tmp_path, source, target, ["k"], ["k", "n", "s"])
    assert rows_of(D.changed_rows(source, target, *paths, ["k"], ["k", "n", "s"], width=8)) == [(3,), (444,), (5,)]
    none = source.filter("k < 0")
    paths = trees(tmp_path / "none", none, none, ["k"])
    assert rows_of(D.reconcile_tree(none, none, *paths, ["k"], width=8)) == []
    with pytest.raises(TypeError):
        D.position(source, "s")


@pytest.mark.parametrize("shift", [-50_000, 0, 10**12])
def test_bitmaps_find_the_duplicates(spark, shift):
    rng = random.Random(shift)
    rows = [(i + shift, f"t{i}") for i in range(70_000)] + [(i + shift, f"t{i}") for i in rng.sample(range(70_000), 11)] + [(None, None)] * 2
    df = spark.createDataFrame(rows, "k long, s string").repartition(5)
    for keys in (["k"], ["k", "s"], ["s"]):
        assert rows_of(duplicates_by_bitmap(df, keys)) == rows_of(C.duplicate_keys(df, keys))
    extremes = spark.createDataFrame([(v,) for v in (2**63 - 1, -(2**63), 0, -1, 1, -32768, 32768, 0)], "k long")
    assert rows_of(duplicates_by_bitmap(extremes, ["k"])) == [(0, 2)]


def test_unique_keys_are_not_exchanged(spark):
    df = spark.range(200_000).select(F.col("id").alias("k"), F.lit("x").alias("s"))
    found = duplicates_by_bitmap(df.withColumn("k", F.col("k") * 1), ["k"])
    assert found.count() == 0
    # What moved was a row per bitmap and task, not a row per key.
    assert crowded_bitmaps(df, F.col("k")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan or "isnull(k" in plan.lower() or "LocalTableScan" in plan
    composite = duplicates_by_bitmap(df.limit(0), ["k", "s"])
    assert composite.collect() == [] and "Exchange" not in composite._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("policy", [P.ErrorPolicy("skip_row"), P.ErrorPolicy("skip_row", 3), P.ErrorPolicy("log_only"), P.ErrorPolicy("stop")])
@pytest.mark.parametrize("n", [0, 500])
def test_observed_counts_are_those_of_a_second_pass(spark, tmp_path, policy, n):
    code = F.when(F.col("k") % 100 == 7, "CAST").when(F.col("k") % 100 == 9, "DUP_PK")
    why = F.when(code.isNotNull(), F.array(F.struct(code.alias("reason"), F.lit("c").alias("column"), F.lit("v").alias("value"))))
    path = str(tmp_path / "rows")
    rows = spark.range(n).select(F.col("id").alias("k"))
    rows.withColumn(C.REASONS, F.coalesce(why, C.no_reasons()).cast(C.REASON_TYPE)).write.parquet(path)
    checked = spark.read.parquet(path)
    load = P.observed_load(checked, policy, ["k"], "S", "T")
    load.accepted.write.parquet(str(tmp_path / "out"))
    assert rows_of(load.counts()) == rows_of(P.import_counts(checked, policy, ["k"], "S", "T"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(P.loaded_rows(checked, policy, ["k"]))
    met = P.rows_met(checked, ["k"], P.load_end(checked, policy, ["k"]))
    by_reason = met.select(F.inline(C.REASONS)).groupBy("reason").count()
    assert rows_of(load.reasons().select("reason", "n")) == rows_of(by_reason)
