"""Keys that own a third of all rows, rows without keys, and exact copies."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrywright.operators import checks as C
from ferrywright.operators import numbering as N
from ferrywright.operators import reconcile as R
from ferrywright.operators.keyed import attach_facts
from ferrywright.spec import ForeignKey

ROWS = 6000


@pytest.fixture
def rows(spark):
    """A third of the rows has key 1, a third none, the rest keys of their own."""
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    return spark.range(0, ROWS, 1, 6).select(F.col("id").alias("seq"), key.alias("k")).cache()


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_facts_by_either_way(spark, rows, always_shuffle, hot_rows):
    facts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    got = attach_facts(rows, facts, ["k"], F.col("last"), "last", "n", hot_rows)
    assert got.count() == ROWS
    local = [tuple(r) for r in rows.collect()]
    last = {}
    for seq, k in local:
        last[k] = max(seq, last.get(k, -1))
    expected = Counter((seq, k, None if k is None else last[k]) for seq, k in local)
    assert Counter(tuple(r) for r in got.select("seq", "k", "last").collect()) == expected


def test_hot_rows_are_spread(spark, rows, always_shuffle):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    facts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = attach_facts(rows, facts, ["k"], F.lit(True), "found", "n", hot_rows=10)
    largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Without salt the hot key alone, and the rows without key alone, are 2000 each.
    assert largest < ROWS // 3


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_duplicates_of_a_hot_key(rows, always_shuffle, hot_rows):
    marked = C.mark_duplicates(rows.withColumn(C.REASONS, C.no_reasons()), ["k"], ["seq"], hot_rows=hot_rows)
    kept = marked.filter(F.size(C.REASONS) == 0)
    assert marked.count() == ROWS
    assert kept.filter("k = 1").collect()[0]["seq"] == 0
    assert kept.filter("k = 1").count() == 1
    assert kept.filter("k is null").count() == ROWS // 3
    assert kept.count() == 1 + 2 * (ROWS // 3)


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_orphans_of_a_hot_key(spark, rows, always_shuffle, hot_rows):
    parent = rows.filter("k % 2 = 0").select(F.col("k").alias("pk")).distinct()
    fk = ForeignKey(("k",), "p", ("pk",), "SET NULL")
    cleared = C.apply_delete_rule(rows, parent, fk, hot_rows)
    expected = sorted((r["seq"], r["k"] if r["k"] is not None and r["k"] % 2 == 0 else None) for r in rows.collect())
    assert sorted(tuple(r) for r in cleared.collect()) == expected
    cascade = C.apply_delete_rule(rows, parent, ForeignKey(("k",), "p", ("pk",), "CASCADE"), hot_rows)
    assert sorted(r["seq"] for r in cascade.collect()) == sorted(
        r["seq"] for r in rows.collect() if r["k"] is None or r["k"] % 2 == 0
    )


def test_numbers_spread_a_shared_key(spark):
    copies = spark.range(0, ROWS, 1, 6).select(F.lit("same").alias("a"), F.lit(1).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = N.range_ordered(copies, ["a"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread < ROWS // 3
    numbered = N.number_rows(copies, ["a"])
    assert sorted(r[0] for r in numbered.select(N.ROW_NUMBER).collect()) == list(range(1, ROWS + 1))


def test_first_row_of_exact_copies(spark):
    copies = spark.range(ROWS).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("v"))
    assert [tuple(r) for r in C.first_rows(copies, ["k"], ["v"]).collect()] == [(1, 0)]


def test_bag_difference_writes_copies_in_chunks(spark):
    left = spark.range(ROWS).select(F.lit("x").alias("a"), (F.col("id") % 3).alias("b"))
    right = left.limit(0).unionAll(spark.range(500).select(F.lit("x").alias("a"), F.lit(1).cast("long").alias("b")))
    got = Counter(tuple(r) for r in R.bag_difference(left, right, chunk=64).collect())
    assert got == Counter({("x", 0): 2000, ("x", 1): 1500, ("x", 2): 2000})


def test_reconcile_does_not_pair_copies(spark, rows):
    keyed = rows.filter("k is not null").select("k")
    out = R.reconcile_by_key(keyed, keyed.filter("k <> 2").unionAll(spark.range(10**6, 10**6 + 5).toDF("k")), ["k"]).first()
    assert out["source_rows"] == 4000
    assert (out["missing"], out["extra"]) == (1, 5)
    assert out["matched"] == keyed.distinct().count() - 1
