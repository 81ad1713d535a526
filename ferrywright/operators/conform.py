"""Cast columns of one database's types to Spark types, and on to what a target stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.dialects import column_type, family, logical_type, normal_type_name
from ferrywright.functions import values as V
from ferrywright.spec import ColumnSpec, LogicalType, TableSpec, spark_type


def conform_value(c: Column, logical: LogicalType) -> Column:
    """Text or a loosely typed value in the logical type; NULL where it does not fit."""
    dtype = spark_type(logical)
    if isinstance(dtype, T.BinaryType):
        return V.hex_to_binary(c)
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    return c.try_cast(dtype)


def conform(df: DataFrame, table: TableSpec, extra: Sequence[str] = ()) -> DataFrame:
    """Declared columns in ordinal order with their Spark types; `extra` columns pass through."""
    typed = [conform_value(F.col(c.name), column_type(table, c)).alias(c.name) for c in table.ordered()]
    return df.select(*typed, *extra)


# --- values for a target --------------------------------------------------------


def for_target(df: DataFrame, table: TableSpec, target: str) -> DataFrame:
    """Typed columns as the target stores them; one projection, no shuffle."""
    fam = family(target)
    cols = [target_value(F.col(c.name), column_type(table, c), fam).alias(c.name) for c in table.ordered()]
    return df.select(*cols)


def target_value(c: Column, logical: LogicalType, target: str) -> Column:
    return _TARGETS[family(target)](c, logical)


def target_overflow(c: Column, logical: LogicalType, target: str) -> Column:
    """Whether a value exists but the target's type cannot hold it, or not without losing its fraction."""
    lost = target_value(c, logical, target).isNull() & ~_becomes_null(c, logical, target)
    if family(target) in ("sqlite3", "duckdb") and logical.base == "NUMERIC" and logical.scale <= 0:
        lost = lost | (c != F.floor(c))
    return c.isNotNull() & lost


def target_refuses(c: Column, logical: LogicalType, target: str, required: bool) -> Column:
    """Whether the target cannot take a value: it overflows, or is stored as NULL where one is not allowed."""
    refused = target_overflow(c, logical, target)
    return refused | (c.isNotNull() & _becomes_null(c, logical, target)) if required else refused


def _becomes_null(c: Column, logical: LogicalType, target: str) -> Column:
    if family(target) == "oracle" and isinstance(spark_type(logical), T.StringType):
        return c == ""
    return F.lit(False)


def _utc_wall_clock(c: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def _to_oracle(c: Column, logical: LogicalType) -> Column:
    if logical.base == "BOOLEAN":
        return c.cast("int").cast("decimal(1,0)")
    if isinstance(spark_type(logical), T.StringType):
        return V.empty_to_null(c)
    return c


def _to_postgres(c: Column, logical: LogicalType) -> Column:
    return c


def _to_mysql(c: Column, logical: LogicalType) -> Column:
    if logical.base == "BOOLEAN":
        return c.cast("tinyint")
    if logical.base == "TIMESTAMPTZ":
        return _utc_wall_clock(c)
    return c


def _to_sqlite(c: Column, logical: LogicalType) -> Column:
    if logical.base in ("SMALLINT", "INT", "BIGINT", "BOOLEAN"):
        return c.cast("long")
    if logical.base in ("FLOAT", "DOUBLE"):
        return c.cast("double")
    if logical.base == "NUMERIC":
        # Scaled numbers become REAL and lose digits; unscaled ones become INTEGER.
        return c.cast("double") if logical.scale > 0 else c.try_cast("bigint")
    if logical.base == "DATE":
        return F.date_format(c, "yyyy-MM-dd")
    if logical.base in ("DATETIME", "TIMESTAMP"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if logical.base == "TIMESTAMPTZ":
        return F.date_format(_utc_wall_clock(c), "yyyy-MM-dd HH:mm:ss")
    return c


def _to_duckdb(c: Column, logical: LogicalType) -> Column:
    if logical.base == "NUMERIC" and logical.scale <= 0:
        return c.try_cast("bigint")
    if logical.base == "TIMESTAMPTZ":
        return _utc_wall_clock(c)
    return c


_TARGETS = {
    "oracle": _to_oracle,
    "postgres": _to_postgres,
    "mysql": _to_mysql,
    "sqlite3": _to_sqlite,
    "duckdb": _to_duckdb,
}

# --- column types of a table to be created ----------------------------------------

# What other databases call their text without a length, where one has to be named.
_MYSQL_LENGTH = 255


def created_type(column: ColumnSpec, target: str, dialect: str = "oracle") -> str | None:
    """Declared type of one created column, or None to leave it to the JDBC dialect.

    Declared lengths and precisions carry over. A plain type name of the SQL standard
    means the same in every dialect, also where the source stores it in a wider number.
    """
    declared = logical_type(dialect, column.type_name, column.length, column.precision, column.scale)
    if declared.base in ("VARCHAR", "CHAR") and column.length > 0:
        return f"{declared.base}({column.length})"
    if column.precision > 0 and isinstance(spark_type(declared), T.NumericType) and declared.base not in ("FLOAT", "DOUBLE"):
        digits = (min(column.precision, 38), column.scale)
        return f"DECIMAL({','.join(str(d) for d in digits if d > 0)})"
    standard = logical_type("postgres", normal_type_name(column.type_name))
    kind = spark_type(standard)
    fam = family(target)
    if fam == "oracle":
        if isinstance(kind, T.IntegralType):
            return f"DECIMAL({_most_digits(kind)})"
        if isinstance(kind, T.BooleanType):
            return "DECIMAL(1)"
        return standard.base if standard.base in ("FLOAT", "DOUBLE", "TIMESTAMP") else None
    if fam == "mysql":
        if isinstance(kind, T.StringType):
            return f"{declared.base}({_MYSQL_LENGTH})" if declared.base in ("VARCHAR", "CHAR") else None
        if isinstance(kind, T.BooleanType):
            return "TINYINT"
        names = {"INT": "INTEGER", "TIMESTAMPTZ": "TIMESTAMP"}
        return names.get(standard.base, standard.base) if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) and standard.base != "NUMERIC" else None
    return None


def _most_digits(kind: T.IntegralType) -> int:
    bits = {T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
    return len(str(2 ** (bits - 1)))


def create_table_column_types(table: TableSpec, target: str) -> str:
    """Value of the JDBC writer option `createTableColumnTypes`."""
    typed = [(c.name, created_type(c, target, table.dialect)) for c in table.ordered()]
    return ", ".join(f"{name} {kind}" for name, kind in typed if kind)
