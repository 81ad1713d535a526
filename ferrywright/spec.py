"""Declared shape of a table: columns with their source types, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class LogicalType:
    """A type that does not depend on a database; zero means "not given"."""

    base: str
    length: int = 0
    precision: int = 0
    scale: int = 0


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_name: str
    length: int = 0
    precision: int = 0
    scale: int = 0
    nullable: bool = True
    ordinal: int = 0
    enum_values: tuple[str, ...] = ()
    length_in_bytes: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    delete_rule: str = "NO ACTION"


@dataclass(frozen=True)
class TableSpec:
    schema: str
    name: str
    columns: tuple[ColumnSpec, ...]
    dialect: str = "oracle"
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.schema or not self.name:
            raise ValueError("a table needs a schema and a name")
        seen: set[str] = set()
        for column in self.columns:
            if column.name.lower() in seen:
                raise ValueError(f"duplicate column {column.name!r} in {self.full_name}")
            seen.add(column.name.lower())

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def landing_name(self) -> str:
        """Base name of the landing file or folder."""
        return f"{self.schema.lower()}.{self.name.lower()}.csv"

    def resolve(self, table: str) -> str:
        """The one form under which a table that this one names is looked up.

        Names are compared without case; one without a schema is in the schema of this table.
        """
        return (table if "." in table else f"{self.schema}.{table}").lower()

    def column(self, name: str) -> ColumnSpec:
        for column in self.columns:
            if column.name.lower() == name.lower():
                return column
        raise KeyError(f"{self.full_name} has no column {name!r}")

    def ordered(self) -> list[ColumnSpec]:
        """Columns by ordinal; columns without one keep their written order."""
        return [c for _, c in sorted(enumerate(self.columns), key=lambda p: (p[1].ordinal or p[0] + 1, p[0]))]


def header_spec(schema: str, name: str, header: list[str]) -> TableSpec:
    """Spec of a table known only by its header line: nullable text, ordinal = position."""
    columns = tuple(ColumnSpec(h, "VARCHAR", ordinal=i) for i, h in enumerate(header, start=1))
    return TableSpec(schema, name, columns, dialect="postgres")


def spark_type(logical: LogicalType) -> T.DataType:
    """Spark type that holds the values of a logical type."""
    if logical.base == "NUMERIC":
        if logical.precision <= 0:
            return T.DecimalType(38, 10)
        precision = min(logical.precision, 38)
        return T.DecimalType(precision, min(max(logical.scale, 0), precision))
    return _SPARK_TYPES[logical.base]


# Lengths stay in the spec: a CharType would pad, and a VarcharType would fail the
# job on the first long value instead of letting it be routed to the rejects.
_SPARK_TYPES: dict[str, T.DataType] = {
    "VARCHAR": T.StringType(),
    "CHAR": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "SMALLINT": T.ShortType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMPTZ": T.TimestampType(),
    "INTERVAL": T.DayTimeIntervalType(),
    "INTERVALYM": T.YearMonthIntervalType(),
    "INTERVALDS": T.DayTimeIntervalType(),
    "BOOLEAN": T.BooleanType(),
    "CLOB": T.StringType(),
    "BLOB": T.BinaryType(),
    "JSON": T.StringType(),
    "XML": T.StringType(),
    "ENUM": T.StringType(),
    "BINARY": T.BinaryType(),
    "VARBINARY": T.BinaryType(),
    "ROWID": T.StringType(),
}
