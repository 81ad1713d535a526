"""Counts per table and run, error summaries, key statistics and data profiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions import values as V

COUNTS = ("expected", "actual", "skipped", "errors")


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Results of all tables or checks in one frame."""
    return reduce(DataFrame.unionByName, parts)


def export_counts(df: DataFrame, schema: str, table: str, page_size: int = 5000) -> DataFrame:
    """Rows of one exported table and the number of pages they fill."""
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), F.ceil(rows / F.lit(page_size)).cast("long").alias("batches")).select(
        F.lit(schema).alias("schema"), F.lit(table).alias("table"), "rows", "batches"
    )


def export_totals(counts: DataFrame) -> DataFrame:
    """Tables and rows of a run; a failed table has no row count and adds nothing."""
    return counts.agg(
        F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows")
    )


def status() -> Column:
    partial = (F.col("errors") > 0) | (F.col("skipped") > 0) | (F.col("actual") != F.col("expected"))
    return F.when(partial, F.lit("PARTIAL")).otherwise(F.lit("SUCCESS"))


def with_status(counts: DataFrame) -> DataFrame:
    return counts.withColumn("status", status())


def report_totals(counts: DataFrame) -> DataFrame:
    """Sums over all tables, number of tables that did not come through whole, run status."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    failed = F.count_if(F.col("status") != "SUCCESS").alias("failed_tables")
    return with_status(counts).agg(F.count(F.lit(1)).alias("tables"), *sums, failed).withColumn("status", status())


def counts_by_status(
    rows: DataFrame, schema: str = "schema", table: str = "table", accepted: str = "accepted"
) -> DataFrame:
    """Counts of many tables at once from rows tagged with schema and table, plus the grand total.

    The total row has NULL for schema and table.
    """
    ok = F.count_if(F.col(accepted))
    bad = F.count_if(~F.col(accepted))
    per_table = rows.groupBy(schema, table).agg(
        F.count(F.lit(1)).alias("expected"), ok.alias("actual"), bad.alias("skipped"), bad.alias("errors")
    )
    total = per_table.agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    null = F.lit(None).cast("string")
    return per_table.unionByName(total.select(null.alias(schema), null.alias(table), *COUNTS))


def errors_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("schema", "table", "reason", "column").agg(F.count(F.lit(1)).alias("n"))


def key_statistics(df: DataFrame, keys: Sequence[Sequence[str]], table: str) -> DataFrame:
    """Rows, rows with a complete key, and distinct keys for every declared key.

    One aggregate per key: several distinct counts in one aggregate would copy every row
    once per key.
    """
    parts = []
    for key in keys:
        groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        complete = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
        parts.append(
            groups.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
                F.coalesce(F.sum(F.when(complete, F.col("_n"))), F.lit(0)).cast("long").alias("keyed_rows"),
                F.count_if(complete).alias("distinct_keys"),
            ).select(F.lit(table).alias("table"), F.lit(",".join(key)).alias("key"), "rows", "keyed_rows", "distinct_keys")
        )
    return union_all(parts)


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """Per column: rows, NULLs, longest text, most digits before and after the point.

    One pass over the table; the wide result is turned into one row per column.
    """
    measures = []
    for f in df.schema.fields:
        c = F.col(f.name)
        whole, fraction = _digits(c, f.dataType)
        measures.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(c.isNull()).alias("nulls"),
                F.max(_length(c, f.dataType)).cast("long").alias("max_length"),
                F.max(whole).cast("long").alias("max_digits"),
                F.max(fraction).cast("long").alias("max_scale"),
            )
        )
    wide = df.agg(F.array(*measures).alias("_columns"))
    return wide.select(F.lit(table).alias("table"), F.inline("_columns"))


def _length(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return F.octet_length(c)
    if isinstance(dtype, T.StringType):
        return F.char_length(c)
    return F.lit(None).cast("int")


def _digits(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    if not isinstance(dtype, T.NumericType):
        none = F.lit(None).cast("int")
        return none, none
    text = F.regexp_replace(V.value_text(c, dtype), "^-", "")
    # 1e+21 and NaN have no digits to count.
    text = F.when(text.rlike(r"^[0-9.]+$"), text)
    return F.char_length(F.split_part(text, F.lit("."), F.lit(1))), F.char_length(F.split_part(text, F.lit("."), F.lit(2)))


def profile_against(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Profile next to the declared attributes, with what the data exceeds.

    `declared` has `table, column, length, precision, nullable`, one row per column.
    """
    joined = profile.join(declared, ["table", "column"])
    longer = (F.col("length") > 0) & (F.col("max_length") > F.col("length"))
    wider = (F.col("precision") > 0) & (F.col("max_digits") + F.col("max_scale") > F.col("precision"))
    return joined.withColumn("too_long", F.coalesce(longer, F.lit(False))).withColumn(
        "too_wide", F.coalesce(wider, F.lit(False))
    ).withColumn("null_in_required", ~F.col("nullable") & (F.col("nulls") > 0))


def report_document(counts: DataFrame, source: str, target: str) -> DataFrame:
    """The run as one nested row: every table's counts, the totals and the status."""
    table = F.struct("schema", "table", *COUNTS)
    # One entry per table of the run.
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in COUNTS]
    run = with_status(counts).agg(
        F.array_sort(F.collect_list(table)).alias("tables"),
        *sums,
        F.when(F.count_if(F.col("status") != "SUCCESS") > 0, "PARTIAL").otherwise("SUCCESS").alias("status"),
    )
    return run.select(
        F.lit(source).alias("source_dialect"),
        F.lit(target).alias("target_dialect"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
        "*",
    )
