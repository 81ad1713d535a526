"""What several operators need: words, row numbers, names, components of links."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywright.session import stage

# White space between words: space and the five control characters from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
# Texts can be long, so few of them travel in one Arrow batch.
ARROW_ROWS = "128"
_LEAST_CUTS = "spark.sql.files.minPartitionNum"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def small_batches(df: DataFrame) -> None:
    """Bound what a Python worker holds at once: read when the plan is made."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def staged(df: DataFrame, label: str) -> DataFrame:
    """`stage`, after which Spark may delete the shuffle files of the jobs before.

    They go when the driver's garbage is collected, which a driver with little to do puts off
    for long; an operator of many jobs would keep the files of all of them.
    """
    out = stage(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where `df` already has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame) -> DataFrame:
    """`df` itself if it is read in a fixed order, otherwise a staged copy of it.

    Rows that come out of a shuffle may change places when a task is repeated, so that
    row numbers given to them would not be the same in two readings. While files are few,
    Spark cuts them by the number of cores it has just then; the first such number is kept
    for the session, so that executors that come or go do not move the cuts.
    """
    conf = df.sparkSession.conf
    if conf.get(_LEAST_CUTS, None) is None:
        now = int(conf.get("spark.sql.leafNodeDefaultParallelism", None) or df.sparkSession.sparkContext.defaultParallelism)
        # Executors may not have arrived yet.
        conf.set(_LEAST_CUTS, str(max(now, 32)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stage(df, "settled") if "Exchange" in plan else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A number per row that is the same in every reading of a settled frame."""
    return df.withColumn(name, F.monotonically_increasing_id())


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, root) of all nodes that have an edge; `edges` has long columns a and b.

    Alternates large and small stars: every node first hands its larger neighbours to its
    smallest one, then does the same with the smaller ones, until each component is a star
    around its smallest node. The number of rounds grows with the logarithm of the longest
    path. Minima are reduced before the shuffle; nodes with very many neighbours only meet
    in a join, which adaptive execution splits.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        before = state
        now = stage(_small_star(_large_star(now)), "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(lowest, "a").filter("b > a and b <> m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(lowest.select("a", "m")).distinct()
