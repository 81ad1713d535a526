"""Dense row numbers in key order, and what is derived from them.

A global `row_number()` moves the whole table into one task. Here the rows are written
once in range order, every file keeps its own row positions, and a row's number is its
position plus the rows of all earlier files. The only single-task step is a running sum
over one count per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.session import scratch_path

ROW_NUMBER = "row_num"


def range_ordered(df: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """Rows in key order over all partitions, equal amounts in each.

    Range partitioning keeps equal keys together, so a key on a third of all rows would
    fill one partition. Unless the keys are declared unique, a hash of the row and the
    number of its input partition break ties; the latter also separates exact copies.
    """
    if unique:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tied = df.withColumns({"_tie": F.xxhash64(*hashable), "_part": F.spark_partition_id()})
    by = [*keys, "_tie", "_part"]
    return tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie", "_part")


def number_rows(
    df: DataFrame, keys: Sequence[str], column: str = ROW_NUMBER, unique: bool = False
) -> DataFrame:
    """Rows with a dense 1-based number in key order.

    Rows equal in all keys are numbered in an order of their own; say `unique` when
    there are none. The ordered copy goes to the shared scratch folder, so every later
    reader sees the same numbers even when executors are lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    range_ordered(df, keys, unique).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)

    file = F.col("_metadata.file_name").alias("_part_file")
    # part-00012-...-c003: the task first, then the file within the task.
    order = [
        F.regexp_extract("_part_file", r"^part-(\d+)", 1).cast("int"),
        F.coalesce(F.regexp_extract("_part_file", r"-c(\d+)\.", 1).try_cast("int"), F.lit(0)),
    ]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per written file: bounded by the number of shuffle partitions.
    offsets = (
        stored.select(file)
        .groupBy("_part_file")
        .agg(F.count(F.lit(1)).alias("_part_rows"))
        .select("_part_file", F.coalesce(F.sum("_part_rows").over(before), F.lit(0)).alias("_part_offset"))
    )
    placed = stored.select("*", file, F.col("_metadata.row_index").alias("_part_index"))
    return placed.join(F.broadcast(offsets), "_part_file").select(
        *[F.col(c) for c in df.columns], (F.col("_part_offset") + F.col("_part_index") + 1).alias(column)
    )


def page_of(size: int, number: str = ROW_NUMBER) -> Column:
    """0-based page, batch or commit group of a numbered row."""
    return F.floor((F.col(number) - 1) / F.lit(size)).cast("long")


def page_cursors(numbered: DataFrame, keys: Sequence[str], size: int, number: str = ROW_NUMBER) -> DataFrame:
    """Last key of every page and its row count: where the next page continues."""
    last = (
        numbered.groupBy(page_of(size, number).alias("page"))
        .agg(F.max(F.struct(*keys)).alias("_last"), F.count(F.lit(1)).alias("rows"))
    )
    return last.select("page", *[F.col(f"_last.{k}").alias(k) for k in keys], "rows")


def sequence_value(
    number: Column,
    start: int = 1,
    increment: int = 1,
    min_value: int = 1,
    max_value: int = 2**63 - 1,
    cycle: bool = False,
) -> Column:
    """n-th value of a sequence; NULL once a sequence without cycle is exhausted.

    The first lap runs from `start`, later laps begin at the minimum (at the maximum when
    descending).
    """
    if increment == 0:
        raise ValueError("a sequence needs a non-zero increment")
    room = (max_value - start) if increment > 0 else (start - min_value)
    # A row number is a long, so a longer lap never ends.
    first_lap = min(room // abs(increment) + 1, 2**63 - 1) if room >= 0 else 0
    nth = F.lit(start) + F.lit(increment) * (number - 1)
    if not cycle:
        return F.when(number <= F.lit(first_lap), nth)
    lap = (max_value - min_value) // abs(increment) + 1
    origin = min_value if increment > 0 else max_value
    again = F.lit(origin) + F.lit(increment) * F.pmod(number - 1 - F.lit(first_lap), F.lit(lap))
    return F.when(number <= F.lit(first_lap), nth).otherwise(again)


def assign_sequence(df: DataFrame, keys: Sequence[str], column: str, **sequence) -> DataFrame:
    """Sequence numbers in key order; rows past the end carry NULL and go to `exhausted`."""
    numbered = number_rows(df, keys, "_seq_number")
    return numbered.withColumn(column, sequence_value(F.col("_seq_number"), **sequence)).drop("_seq_number")


def exhausted(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Rejects of `assign_sequence`."""
    return df.filter(F.col(column).isNull()).select(
        *keys, F.lit("SEQ_EXHAUSTED").alias("reason"), F.lit(column).alias("column")
    )


def fill_identity(
    df: DataFrame, column: str, keys: Sequence[str], increment: int = 1, start: int | None = None
) -> DataFrame:
    """BY DEFAULT identity: supplied values stay, missing ones continue after the last.

    The last is the largest value, or the smallest if the increment is negative. Without
    one, or with one before it, the first is `start`, by default one increment from zero.

    Only the rows without a value are ordered and numbered; the others pass through.
    """
    supplied = df.filter(F.col(column).isNotNull())
    missing = number_rows(df.filter(F.col(column).isNull()), keys, "_missing_number")
    first = increment if start is None else start
    pick, further = (F.max, F.greatest) if increment > 0 else (F.min, F.least)
    before = F.lit(first - increment).cast("long")
    last = df.agg(further(F.coalesce(pick(column).cast("long"), before), before)).scalar()
    dtype = df.schema[column].dataType
    generated = (last + F.lit(increment) * F.col("_missing_number")).cast(dtype)
    filled = missing.withColumn(column, generated).drop("_missing_number")
    return supplied.unionByName(filled.select(*df.columns))


def replace_identity(df: DataFrame, column: str, keys: Sequence[str], start: int = 1, increment: int = 1) -> DataFrame:
    """ALWAYS identity: every value is generated anew, in key order, upwards or downwards."""
    numbered = number_rows(df, keys, "_identity_number")
    value = sequence_value(F.col("_identity_number"), start=start, increment=increment, min_value=-(2**63))
    return numbered.withColumn(column, value).drop("_identity_number")


def add_row_id(df: DataFrame, column: str = "row_id") -> DataFrame:
    """A unique row id; not dense, and it needs no shuffle."""
    return df.withColumn(column, F.monotonically_increasing_id())
