"""Profiles from sketches against exact ones, and merged ones against those built whole."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from ferrywright.operators import sketches as K


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "rows")
    rows = spark.range(40_000).select(
        F.col("id").alias("k"), (F.col("id") % 97).alias("few"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7 % 40_000).cast("decimal(12,2)")).alias("price"),
        F.date_add(F.lit(datetime.date(1960, 1, 1)), (F.col("id") % 20_000).cast("int")).alias("day"),
        F.when(F.col("id") % 4 == 0, "often").otherwise(F.concat(F.lit("t"), "id")).alias("name"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("f"),
    )
    rows.repartition(6).write.parquet(path)
    return path


def test_estimates_are_within_their_errors(spark, table):
    df = spark.read.parquet(table)
    merged = K.merge_sketches(K.file_sketches(df))
    found = {r["column"]: r for r in K.profile_of(merged, [0.1, 0.5, 0.9]).collect()}
    assert set(found) == set(df.columns)
    truth = df.agg(*[F.countDistinct(F.col(c)).alias(c) for c in df.columns]).first()
    for name, r in found.items():
        assert r.rows == 40_000
        assert abs(r["distinct"] - truth[name]) <= K.DISTINCT_ERROR * truth[name]
    assert (found["price"].nulls, found["none"].nulls, found["k"].nulls) == (4000, 40_000, 0)
    for q, value in zip((0.1, 0.5, 0.9), found["k"].quantiles):
        assert abs(value / 40_000 - q) <= K.RANK_ERROR
    assert abs(found["day"].quantiles[1] - (-3653 + 10_000)) <= 20_000 * K.RANK_ERROR
    assert found["name"].quantiles is None and found["f"].quantiles is not None
    assert found["name"].frequent[0].item == "often" and found["name"].frequent[0]["count"] >= 10_000
    assert found["none"].frequent == [] or found["none"].frequent[0].item is None


def test_merging_any_files_is_like_reading_them(spark, table, tmp_path):
    store = str(tmp_path / "store")
    assert K.sketch_new_files(spark, table, store) == 6
    assert K.sketch_new_files(spark, table, store) == 0
    sketches = spark.read.parquet(store)
    files = sorted(r.file for r in sketches.select("file").distinct().collect())
    some = K.merge_sketches(sketches.filter(F.col("file").isin(files[:2])))
    whole = K.merge_sketches(K.file_sketches(spark.read.parquet(*files[:2])))
    names = ("column", "rows", "nulls", "distinct")
    rows = [sorted(tuple(r) for r in K.profile_of(m).select(*names).collect()) for m in (some, whole)]
    assert rows[0] == rows[1]
    # The merge reads sketches only.
    assert all("/store/" in f for f in some.inputFiles())


def test_new_and_empty_files(spark, tmp_path):
    path, store = str(tmp_path / "rows"), str(tmp_path / "store")
    spark.createDataFrame([], "a int, s string").write.parquet(path)
    assert K.sketch_new_files(spark, path, store) == 1
    assert K.sketch_new_files(spark, path, store) == 0
    assert K.merge_sketches(spark.read.parquet(store)).count() == 0
    spark.createDataFrame([(1, "x" * 500), (1, None)], "a int, s string").coalesce(1).write.mode("append").parquet(path)
    assert K.sketch_new_files(spark, path, store) == 1
    found = {r["column"]: r for r in K.profile_of(K.merge_sketches(spark.read.parquet(store))).collect()}
    assert (found["a"]["distinct"], found["s"].nulls, found["a"].quantiles) == (1, 1, [1.0, 1.0, 1.0])
    assert all(v.item is None for v in found["s"].frequent)


def test_values_are_made_once_for_all_sketches(spark, table):
    plan = K.file_sketches(spark.read.parquet(table))._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate" in line)
    # The path and the texts come from a projection below.
    assert "regexp_replace" not in aggregate and "date_format" not in aggregate
