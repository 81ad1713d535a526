"""Offline conversion: a landing table to CSV or to an INSERT script, no database."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ferrywright.operators.numbering import range_ordered
from ferrywright.plans.load import Transforms, transform
from ferrywright.session import stage
from ferrywright.sinks.files import write_csv
from ferrywright.sinks.insert_script import STATEMENT_ROWS, write_insert_script
from ferrywright.sources.landing import POSITION, CsvLayout, landed_tables, read_header, read_landing, split_malformed
from ferrywright.sources.selection import TableSelection
from ferrywright.spec import header_spec


def convert_table(
    spark: SparkSession,
    source_folder: str,
    target_folder: str,
    schema: str,
    table: str,
    format: str = "csv",
    layout: CsvLayout = CsvLayout(),
    dialect: str = "postgres",
    rows_per_statement: int = STATEMENT_ROWS,
    truncate: bool = False,
    keys: Sequence[str] = (),
    steps: Transforms | None = None,
) -> str:
    """Convert `{schema}.{table}.csv`; rows keep file order unless `keys` give another one.

    `steps` change the values on the way, which all count as text. A misshapen row fails
    the conversion, as there is nowhere to put it.
    """
    name = f"{schema.lower()}.{table.lower()}.csv"
    path = f"{source_folder.rstrip('/')}/{name}"
    columns = read_header(spark, path, layout)
    rows, _ = split_malformed(_refuse_malformed(read_landing(spark, path, columns, layout, position=True)))
    if steps:
        rows = transform(rows, header_spec(schema, table, columns), steps)
    # Positions depend on how a scan was split, so they are fixed once.
    rows = stage(rows, "convert")
    order = list(keys) or list(POSITION)
    if format == "csv":
        out = f"{target_folder.rstrip('/')}/{name}"
        write_csv(range_ordered(rows, order, unique=not keys).select(*columns), out, layout)
        return out
    if format == "sql":
        return write_insert_script(
            rows, target_folder, schema, table, order, dialect, rows_per_statement, truncate,
            untyped=True, columns=columns,
        )
    raise ValueError(f"unknown format {format!r}")


def convert_folder(
    spark: SparkSession,
    source_folder: str,
    target_folder: str,
    selection: TableSelection = TableSelection(),
    **options,
) -> dict[str, str]:
    """Convert the selected tables of a landing folder; where each went, by `schema.table`.

    `options` are those of `convert_table`. Tables that are not selected are not opened.
    """
    out = {}
    for schema, table in landed_tables(spark, source_folder):
        if selection.chooses(schema, table):
            out[f"{schema}.{table}"] = convert_table(spark, source_folder, target_folder, schema, table, **options)
    return out


def _refuse_malformed(rows):
    message = F.concat(F.lit("misshapen row: "), F.col("_corrupt"))
    checked = F.when(F.col("_corrupt").isNull(), F.col("_corrupt")).otherwise(F.raise_error(message).cast("string"))
    return rows.withColumn("_corrupt", checked)
