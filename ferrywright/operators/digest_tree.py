"""Comparing two large tables by digests of key ranges, reading rows only where they differ.

A tree is stored beside each table. Its leaves are ranges of `width` key positions, each
with the number of its rows and two checksums that do not depend on their order; a node
above holds the sums of `FAN_OUT` ranges. Ranges lie on fixed multiples, so two trees
built apart from each other have the same ones. Comparing goes down from the top into
nodes that differ, and ends with the differing leaves, whose rows alone are read.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions.predicates import disjunction
from ferrywright.operators.reconcile import differing_keys
from ferrywright.session import stage

WIDTH = 1024
FAN_OUT = 16
# Ranges that a scan is given as conditions; more are drawn together over the smallest gaps.
MOST_RANGES = 200
# Differing leaves that the driver looks at; more are joined by a shuffle instead.
MOST_LEAVES = 10_000


def position(df: DataFrame, key: str) -> Column:
    """The place of a key among whole numbers: itself, days of a date, seconds of a timestamp."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and not kind.scale):
        return F.col(key).cast("decimal(38,0)")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("decimal(38,0)")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_seconds(F.col(key).cast("timestamp")).cast("decimal(38,0)")
    raise TypeError(f"ranges need a whole number, a date or a timestamp, not {kind.simpleString()} {key}")


def _leaf(df: DataFrame, key: str, width: int) -> Column:
    return _above(position(df, key), width)


def _above(node: Column, by: int) -> Column:
    return F.floor(node / F.lit(by).cast("decimal(10,0)")).cast("long")


def build_tree(
    df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str] | None = None, width: int = WIDTH, mode: str = "errorifexists"
) -> None:
    """Write the tree of a table: one pass over `columns`, by default the keys, and small steps upwards.

    The first key makes the ranges; rows where it is NULL are a range of their own. A row's
    checksums cover `columns`, so a change in any of them shows.
    """
    row = [F.col(c) for c in (columns or keys)]
    level = df.groupBy(_leaf(df, keys[0], width).alias("node")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit("second"), *row)).alias("parity"),
    )
    number = 0
    while True:
        at = f"{path.rstrip('/')}/level={number}"
        level.write.mode(mode).parquet(at)
        level = df.sparkSession.read.schema(level.schema).parquet(at)
        if level.count() <= FAN_OUT:
            return
        number += 1
        level = level.groupBy(_above(F.col("node").cast("decimal(38,0)"), FAN_OUT).alias("node")).agg(
            F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("parity").alias("parity")
        )


def differing_leaves(spark: SparkSession, source_tree: str, target_tree: str) -> DataFrame:
    """(node) of the leaves whose digests differ; below equal nodes nothing is read."""
    level = min(_height(spark, source_tree), _height(spark, target_tree))
    above = None
    while True:
        sides = []
        for path, sign in ((source_tree, 1), (target_tree, -1)):
            nodes = spark.read.parquet(f"{path.rstrip('/')}/level={level}")
            if above is not None:
                parent = _above(F.col("node").cast("decimal(38,0)"), FAN_OUT)
                nodes = nodes.join(above, parent.eqNullSafe(F.col("_above")), "left_semi")
            sides.append(nodes.select("node", (F.col("rows") * sign).alias("rows"), (F.col("total") * sign).alias("total"), "parity"))
        # Equal digests cancel out.
        sums = sides[0].union(sides[1]).groupBy("node").agg(
            F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity")
        )
        found = stage(sums.filter((F.col("rows") != 0) | (F.col("total") != 0) | (F.col("parity") != 0)).select("node"), "differing")
        if not level or found.isEmpty():
            return found
        above, level = found.withColumnRenamed("node", "_above"), level - 1


def _height(spark: SparkSession, path: str) -> int:
    # The tree of an empty table is one empty level.
    return spark.read.parquet(path).agg(F.max("level")).first()[0] or 0


def rows_of_leaves(df: DataFrame, leaves: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """The rows in these leaves, and perhaps some between them; the ranges reach the scan as conditions on the key."""
    if leaves.limit(MOST_LEAVES + 1).count() > MOST_LEAVES:
        chosen = leaves.select(F.col("node").alias("_node"))
        return df.join(chosen, _leaf(df, key, width).eqNullSafe(F.col("_node")), "left_semi")
    nodes = [r.node for r in leaves.collect()]
    spans = _spans(sorted(n for n in nodes if n is not None))
    kind = df.schema[key].dataType
    ranges = [
        (F.col(key) >= _value(a * width, kind)) & (F.col(key) < _value((b + 1) * width, kind)) for a, b in spans
    ]
    if None in nodes:
        ranges.append(F.col(key).isNull())
    return df.filter(disjunction(ranges)) if ranges else df.filter(F.lit(False))


def _spans(nodes: list[int]) -> list[tuple[int, int]]:
    """First and last of runs of neighbours, at most MOST_RANGES of them."""
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(nodes, nodes[1:]), 1) if b - a > 1), reverse=True)
    cuts = [0, *sorted(i for _, i in gaps[: MOST_RANGES - 1]), len(nodes)]
    return [(nodes[a], nodes[b - 1]) for a, b in zip(cuts, cuts[1:]) if b > a]


def _value(place: int, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        # Beyond the calendar there are no dates to leave out.
        return F.date_from_unix_date(F.lit(max(-719162, min(place, 2932896))))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(F.lit(place))
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(datetime.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(place).cast("decimal(18,6)"))
    return F.lit(place).cast("decimal(38,0)") if isinstance(kind, T.DecimalType) or abs(place) >= 2**63 else F.lit(place)


def reconcile_tree(
    source: DataFrame, target: DataFrame, source_tree: str, target_tree: str, keys: Sequence[str], width: int = WIDTH
) -> DataFrame:
    """`reconcile.differing_keys` of two tables by their trees, both built with this width.

    Tables that are equal cost the tops of two trees; otherwise the rows of the differing
    ranges are compared.
    """
    leaves = differing_leaves(source.sparkSession, source_tree, target_tree)
    return differing_keys(*(rows_of_leaves(side, leaves, keys[0], width) for side in (source, target)), keys)


def changed_rows(
    source: DataFrame, target: DataFrame, source_tree: str, target_tree: str, keys: Sequence[str], columns: Sequence[str], width: int = WIDTH
) -> DataFrame:
    """Keys on both sides whose rows differ in `columns`, over which both trees were built."""
    leaves = differing_leaves(source.sparkSession, source_tree, target_tree)
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    sides = [
        rows_of_leaves(side, leaves, keys[0], width).select(*keys, F.lit(sign).alias("_n"), (row * sign).alias("_total"))
        for side, sign in ((source, 1), (target, -1))
    ]
    both = sides[0].unionAll(sides[1]).groupBy(*keys).agg(
        F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.sum("_n").alias("_n"), F.sum("_total").alias("_total")
    )
    return both.filter("_lo < 0 and _hi > 0 and (_n <> 0 or _total <> 0)").select(*keys)
