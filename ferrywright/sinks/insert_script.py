"""INSERT scripts: n rows per statement, statements in key order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.dialects import family, quote_identifier
from ferrywright.functions.literals import sql_literal, typed_literal
from ferrywright.operators.numbering import ROW_NUMBER, number_rows, page_of

STATEMENT_ROWS = 100


def row_tuple(fields: Sequence[T.StructField], dialect: str, untyped: bool = False) -> Column:
    """`(v1, v2, ...)` of one row; `untyped` reads every value as landing text."""
    literals = [
        sql_literal(F.col(f.name).cast("string"), dialect) if untyped else typed_literal(F.col(f.name), f.dataType, dialect)
        for f in fields
    ]
    return F.concat(F.lit("("), F.concat_ws(", ", *literals), F.lit(")"))


def insert_statements(
    df: DataFrame,
    schema: str,
    table: str,
    keys: Sequence[str],
    dialect: str = "postgres",
    rows_per_statement: int = STATEMENT_ROWS,
    untyped: bool = False,
    quote: bool = True,
    columns: Sequence[str] = (),
) -> DataFrame:
    """`batch, rows, statement`: one INSERT per batch of consecutive rows in key order.

    Range partitioning by batch keeps the script's order over the part files and already
    brings a batch together, so grouping needs no second shuffle. A group never holds
    more than `rows_per_statement` rows. `columns` leaves out columns only used for order.
    """
    fields = [df.schema[c] for c in columns or df.columns]
    names = ", ".join(quote_identifier(f.name, dialect, quote) for f in fields)
    target = f"{quote_identifier(schema, dialect, quote)}.{quote_identifier(table, dialect, quote)}"
    head = f"INSERT INTO {target} ({names})\nVALUES\n  "
    tuples = number_rows(df, keys).select(
        page_of(rows_per_statement).alias("batch"),
        F.col(ROW_NUMBER),
        row_tuple(fields, dialect, untyped).alias("row"),
    )
    grouped = (
        tuples.repartitionByRange("batch")
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list(F.struct(ROW_NUMBER, "row"))).alias("lines"))
    )
    body = F.array_join(F.col("lines.row"), ",\n  ")
    return grouped.select(
        "batch",
        F.size("lines").cast("long").alias("rows"),
        F.concat(F.lit(head), body, F.lit(";")).alias("statement"),
    )


def script_lines(
    statements: DataFrame, schema: str, table: str, dialect: str, truncate: bool = False, quote: bool = True
) -> DataFrame:
    """Text of the script, one record per statement with its transaction around it.

    A transaction surrounds every batch except for MySQL. The optional TRUNCATE opens the
    first record.
    """
    text = F.col("statement")
    if family(dialect) != "mysql":
        text = F.concat(F.lit("BEGIN;\n\n"), text, F.lit("\n\nCOMMIT;\n"))
    else:
        text = F.concat(text, F.lit("\n"))
    if truncate:
        target = f"{quote_identifier(schema, dialect, quote)}.{quote_identifier(table, dialect, quote)}"
        opening = F.when(F.col("batch") == 0, F.lit(f"TRUNCATE TABLE {target};\n\n")).otherwise(F.lit(""))
        text = F.concat(opening, text)
    return statements.sortWithinPartitions("batch").select(text.alias("value"))


def write_insert_script(
    df: DataFrame,
    folder: str,
    schema: str,
    table: str,
    keys: Sequence[str],
    dialect: str = "postgres",
    rows_per_statement: int = STATEMENT_ROWS,
    truncate: bool = False,
    untyped: bool = False,
    quote: bool = True,
    columns: Sequence[str] = (),
    mode: str = "errorifexists",
) -> str:
    """Write `{schema}.{table}.insert.sql` below `folder`; part files follow each other in order."""
    path = f"{folder.rstrip('/')}/{schema.lower()}.{table.lower()}.insert.sql"
    statements = insert_statements(df, schema, table, keys, dialect, rows_per_statement, untyped, quote, columns)
    script_lines(statements, schema, table, dialect, truncate, quote).write.mode(mode).text(path)
    return path
