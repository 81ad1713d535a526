from __future__ import annotations

import datetime
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from ferrywright.operators import numbering as N
from ferrywright.sources import paging as P


def sequence(start, increment, low, high, cycle):
    """Values of a sequence one after the other."""
    value = start
    while True:
        yield value
        value += increment
        if not low <= value <= high:
            if not cycle:
                return
            value = low if increment > 0 else high


@pytest.mark.parametrize(
    "start,increment,low,high,cycle",
    [(1, 1, 1, 999999999, False), (5, 3, 1, 20, False), (5, 3, 1, 20, True), (9, -2, 1, 10, True), (9, -2, 1, 10, False),
     (20, 7, 1, 20, True), (1, 30, 1, 20, True)],
)
def test_sequences_against_a_loop(spark, start, increment, low, high, cycle):
    expected = list(itertools.islice(sequence(start, increment, low, high, cycle), 40))
    expected += [None] * (40 - len(expected))
    n = F.col("id") + 1
    value = N.sequence_value(n, start, increment, low, high, cycle).alias("v")
    assert [r[0] for r in spark.range(40).select("id", value).orderBy("id").select("v").collect()] == expected


def test_numbers_are_dense_and_in_order(spark):
    pairs = [(a, b) for a in range(40) for b in range(25)]
    random.Random(3).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a int, b int").repartition(7)
    for unique in (True, False):
        got = {(r["a"], r["b"]): r[N.ROW_NUMBER] for r in N.number_rows(df, ["a", "b"], unique=unique).collect()}
        assert got == {p: i for i, p in enumerate(sorted(pairs), start=1)}


def test_numbers_of_several_files_per_task(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "60")
    try:
        got = N.number_rows(spark.range(1000).repartition(5), ["id"], unique=True)
        assert got.filter(F.col("id") + 1 != F.col(N.ROW_NUMBER)).count() == 0
        assert got.count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_no_rows(spark):
    assert N.number_rows(spark.range(0), ["id"]).count() == 0


def test_numbers_stay_when_read_again(spark):
    same = spark.range(500).select(F.lit("x").alias("a"), (F.col("id") % 50).alias("b"), "id")
    numbered = N.number_rows(same, ["a"])
    first = {r["id"]: r[N.ROW_NUMBER] for r in numbered.collect()}
    assert first == {r["id"]: r[N.ROW_NUMBER] for r in numbered.select(N.ROW_NUMBER, "id").collect()}


def test_numbering_keeps_rows_distributed(spark):
    plan = N.number_rows(spark.range(1000), ["id"])._jdf.queryExecution().executedPlan().toString()
    # The only single-partition step sums counts per file.
    assert plan.count("SinglePartition") == 1
    assert "BroadcastHashJoin" in plan


def test_identity_columns(spark):
    df = spark.createDataFrame([(1, 7), (2, None), (3, 3), (4, None)], "k int, v int")
    filled = {r["k"]: r["v"] for r in N.fill_identity(df, "v", ["k"]).collect()}
    assert filled == {1: 7, 2: 8, 3: 3, 4: 9}
    always = {r["k"]: r["v"] for r in N.replace_identity(df, "v", ["k"], start=10, increment=5).collect()}
    assert always == {1: 10, 2: 15, 3: 20, 4: 25}
    none = spark.createDataFrame([(1, None), (2, None)], "k int, v int")
    assert sorted(r["v"] for r in N.fill_identity(none, "v", ["k"]).collect()) == [1, 2]


def test_exhausted_sequences_are_rejected(spark):
    keyed = N.assign_sequence(spark.range(5).withColumnRenamed("id", "k"), ["k"], "new", start=1, max_value=3)
    assert sorted(r["k"] for r in N.exhausted(keyed, "new", ["k"]).collect()) == [3, 4]


def test_pages_of_a_composite_key_lose_nothing(spark):
    pairs = [(a, b, c) for a in range(6) for b in range(5) for c in ("x", "y")]
    df = spark.createDataFrame(pairs, "a int, b int, c string")
    seen, last = [], None
    while True:
        page = [tuple(r) for r in P.keyset_page(df, ["a", "b", "c"], 7, last).collect()]
        if not page:
            break
        seen += page
        last = dict(zip("abc", page[-1]))
    assert seen == sorted(pairs)


def test_keyset_filter_reaches_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("b")).write.parquet(path)
    page = P.keyset_page(spark.read.parquet(path), ["b", "id"], 5, {"b": 3, "id": 10})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(b,3)" in plan and "TakeOrderedAndProject" in plan


def test_a_time_cursor_does_not_depend_on_the_process_zone(spark, monkeypatch):
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2020-01-01', TIMESTAMP_NTZ'2020-01-02', INTERVAL 1 HOUR)) AS h")
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        page = P.keyset_page(hours, ["h"], 2, {"h": datetime.datetime(2020, 1, 1, 5)}).collect()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert [r["h"].hour for r in page] == [6, 7]


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError):
        P.fold_columns(spark.range(1).selectExpr("id AS a", "id AS A"), "postgres")
