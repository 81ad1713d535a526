"""Column types of the supported databases as logical types, and rule sets over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ferrywright.spec import ColumnSpec, LogicalType, TableSpec

# Dialect name -> family whose type table, quoting and casing it shares.
DIALECT_FAMILY = {
    "oracle": "oracle",
    "postgres": "postgres",
    "postgresql": "postgres",
    "mysql": "mysql",
    "sqlite3": "sqlite3",
    "sqlite": "sqlite3",
    "duckdb": "duckdb",
    "goldendb": "mysql",
    "goldendb-mysql": "mysql",
    "goldendb-oracle": "oracle",
    "oceanbase": "mysql",
    "oceanbase-mysql": "mysql",
    "oceanbase-oracle": "oracle",
    "panweidb": "postgres",
    "panweidb-mysql": "mysql",
    "panweidb-oracle": "oracle",
    "opengaussdb": "postgres",
}

# Type name -> logical base, per family. NUMBER is resolved by rule below.
TYPE_BASES = {
    "oracle": {
        "VARCHAR2": "VARCHAR",
        "NVARCHAR2": "VARCHAR",
        "CHAR": "CHAR",
        "NCHAR": "CHAR",
        "BINARY_FLOAT": "FLOAT",
        "BINARY_DOUBLE": "DOUBLE",
        "DATE": "DATETIME",
        "TIMESTAMP": "TIMESTAMP",
        "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
        "TIMESTAMP WITH LOCAL TIME ZONE": "TIMESTAMPTZ",
        "CLOB": "CLOB",
        "NCLOB": "CLOB",
        "LONG": "CLOB",
        "BLOB": "BLOB",
        "LONG RAW": "BLOB",
        "RAW": "VARBINARY",
        "BFILE": "VARBINARY",
        "ROWID": "ROWID",
        "UROWID": "ROWID",
        "XMLTYPE": "XML",
    },
    "postgres": {
        "VARCHAR": "VARCHAR",
        "CHARACTER VARYING": "VARCHAR",
        "CHAR": "CHAR",
        "CHARACTER": "CHAR",
        "TEXT": "CLOB",
        "SMALLINT": "SMALLINT",
        "INT2": "SMALLINT",
        "INTEGER": "INT",
        "INT": "INT",
        "INT4": "INT",
        "BIGINT": "BIGINT",
        "INT8": "BIGINT",
        "REAL": "FLOAT",
        "FLOAT4": "FLOAT",
        "DOUBLE PRECISION": "DOUBLE",
        "FLOAT8": "DOUBLE",
        "NUMERIC": "NUMERIC",
        "DECIMAL": "NUMERIC",
        "BOOLEAN": "BOOLEAN",
        "BOOL": "BOOLEAN",
        "DATE": "DATE",
        "TIME": "TIME",
        "TIMESTAMP": "TIMESTAMP",
        "TIMESTAMPTZ": "TIMESTAMPTZ",
        "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
        "INTERVAL": "INTERVAL",
        "BYTEA": "BLOB",
        "JSON": "JSON",
        "JSONB": "JSON",
        "XML": "XML",
        "UUID": "VARCHAR",
        "INET": "VARCHAR",
        "CIDR": "VARCHAR",
        "MACADDR": "VARCHAR",
    },
    "mysql": {
        "VARCHAR": "VARCHAR",
        "CHAR": "CHAR",
        "TEXT": "CLOB",
        "TINYTEXT": "CLOB",
        "MEDIUMTEXT": "CLOB",
        "LONGTEXT": "CLOB",
        "TINYINT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "YEAR": "SMALLINT",
        "MEDIUMINT": "INT",
        "INT": "INT",
        "INTEGER": "INT",
        "BIGINT": "BIGINT",
        "SERIAL": "BIGINT",
        "FLOAT": "FLOAT",
        "DOUBLE": "DOUBLE",
        "DOUBLE PRECISION": "DOUBLE",
        "REAL": "DOUBLE",
        "DECIMAL": "NUMERIC",
        "NUMERIC": "NUMERIC",
        "FIXED": "NUMERIC",
        "BOOLEAN": "BOOLEAN",
        "BOOL": "BOOLEAN",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "DATETIME",
        "TIMESTAMP": "TIMESTAMP",
        "BLOB": "BLOB",
        "TINYBLOB": "BLOB",
        "MEDIUMBLOB": "BLOB",
        "LONGBLOB": "BLOB",
        "BINARY": "BINARY",
        "VARBINARY": "VARBINARY",
        "JSON": "JSON",
        "ENUM": "ENUM",
        "SET": "VARCHAR",
    },
    "sqlite3": {
        "TEXT": "VARCHAR",
        "VARCHAR": "VARCHAR",
        "CHARACTER VARYING": "VARCHAR",
        "CLOB": "VARCHAR",
        "TINYINT": "INT",
        "SMALLINT": "INT",
        "INT": "INT",
        "INTEGER": "INT",
        "BIGINT": "INT",
        "REAL": "FLOAT",
        "FLOAT": "FLOAT",
        "DOUBLE": "FLOAT",
        "NUMERIC": "NUMERIC",
        "DECIMAL": "NUMERIC",
        "BLOB": "BLOB",
        "BOOLEAN": "BOOLEAN",
        "DATE": "DATE",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
    },
    "duckdb": {
        "VARCHAR": "VARCHAR",
        "TEXT": "VARCHAR",
        "STRING": "VARCHAR",
        "CLOB": "VARCHAR",
        "CHAR": "CHAR",
        "BPCHAR": "CHAR",
        "TINYINT": "SMALLINT",
        "INT1": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "INT2": "SMALLINT",
        "INTEGER": "INT",
        "INT": "INT",
        "INT4": "INT",
        "INT32": "INT",
        "BIGINT": "BIGINT",
        "INT8": "BIGINT",
        "INT64": "BIGINT",
        "HUGEINT": "NUMERIC",
        "INT128": "NUMERIC",
        "FLOAT": "FLOAT",
        "REAL": "FLOAT",
        "FLOAT4": "FLOAT",
        "DOUBLE": "DOUBLE",
        "FLOAT8": "DOUBLE",
        "DECIMAL": "NUMERIC",
        "NUMERIC": "NUMERIC",
        "BOOLEAN": "BOOLEAN",
        "BOOL": "BOOLEAN",
        "DATE": "DATE",
        "TIME": "TIME",
        "BLOB": "BLOB",
        "BYTEA": "BLOB",
        "JSON": "JSON",
    },
}

# Type-name prefixes -> logical base.
TYPE_PREFIXES = {
    "postgres": {"SERIAL": "BIGINT"},
    "duckdb": {"TIMESTAMP": "TIMESTAMP", "INTERVAL": "INTERVAL"},
}

# Lengths implied by a type name.
IMPLIED_LENGTH = {("postgres", "UUID"): 36, ("mysql", "SET"): 255}

# Spellings that mean another type name.
TYPE_SPELLINGS = {
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "CHARACTER VARYING": "VARCHAR",
    "USER-DEFINED": "TEXT",
}

# Bases that carry a declared length / a precision and scale.
_LENGTH_BASES = {"VARCHAR", "CHAR", "VARBINARY", "BINARY", "ROWID"}


def family(dialect: str) -> str:
    """Family of a dialect name; raises on a name nobody registered."""
    try:
        return DIALECT_FAMILY[dialect.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown dialect {dialect!r}") from None


def normal_type_name(type_name: str) -> str:
    """Upper case, single blanks, standard spelling."""
    name = " ".join(type_name.upper().split())
    return TYPE_SPELLINGS.get(name, name)


def logical_type(dialect: str, type_name: str, length: int = 0, precision: int = 0, scale: int = 0) -> LogicalType:
    """Logical type of one declared column; unknown names are text."""
    fam = family(dialect)
    # TIMESTAMP(6) WITH TIME ZONE is looked up without its fraction digits.
    name = " ".join(re.sub(r"\([^)]*\)", " ", type_name.upper()).split())
    if fam == "oracle" and name == "NUMBER":
        return _oracle_number(precision, scale)
    base = TYPE_BASES[fam].get(name)
    if base is None:
        prefixes = TYPE_PREFIXES.get(fam, {})
        base = next((b for p, b in prefixes.items() if name.startswith(p)), "VARCHAR")
    if base == "NUMERIC":
        return LogicalType(base, precision=precision, scale=scale)
    if base in _LENGTH_BASES:
        return LogicalType(base, length=IMPLIED_LENGTH.get((fam, name), length))
    return LogicalType(base)


def _oracle_number(precision: int, scale: int) -> LogicalType:
    # NUMBER without precision holds any number, so it must not become a short.
    if precision > 0 and scale == 0:
        for limit, base in ((4, "SMALLINT"), (9, "INT"), (18, "BIGINT")):
            if precision <= limit:
                return LogicalType(base, precision=precision)
    return LogicalType("NUMERIC", precision=precision, scale=scale)


def column_type(table: TableSpec, column: ColumnSpec) -> LogicalType:
    return logical_type(table.dialect, column.type_name, column.length, column.precision, column.scale)


def fold_identifier(name: str, dialect: str) -> str:
    """Casing a target stores unquoted names in."""
    fam = family(dialect)
    if fam == "postgres":
        return name.lower()
    return name.upper() if fam == "oracle" else name


def quote_identifier(name: str, dialect: str, quote: bool = True) -> str:
    """Identifier as written in an INSERT script."""
    if not quote:
        return name
    mark = "`" if family(dialect) == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def takes_numeric_booleans(dialect: str) -> bool:
    """Targets that store booleans as 1 and 0 (the PostgreSQL-kernel modes do not)."""
    return not dialect.lower().startswith("panweidb") and family(dialect) in ("mysql", "oracle")


@dataclass(frozen=True)
class ParamRule:
    """One conditional mapping; conditions left at None do not restrict."""

    target: str
    scale: int | None = None
    scale_gt: int | None = None
    min_precision: int | None = None
    max_precision: int | None = None
    min_length: int | None = None
    max_length: int | None = None

    def accepts(self, c: ColumnSpec) -> bool:
        bounds = (
            self.scale is None or c.scale == self.scale,
            self.scale_gt is None or c.scale > self.scale_gt,
            self.min_precision is None or c.precision >= self.min_precision,
            self.max_precision is None or c.precision <= self.max_precision,
            self.min_length is None or c.length >= self.min_length,
            self.max_length is None or c.length <= self.max_length,
        )
        return all(bounds)


@dataclass(frozen=True)
class NameRule:
    """Override by column name, optionally only for one source type and length."""

    pattern: str
    target: str
    type_name: str = ""
    length: int = 0

    def accepts(self, c: ColumnSpec) -> bool:
        return (
            re.search(self.pattern, c.name) is not None
            and self.type_name.lower() in ("", c.type_name.lower())
            and self.length in (0, c.length)
        )


@dataclass(frozen=True)
class TypeRules:
    """Rules from one database's types to another's: by name, by parameters, exact, unchanged."""

    target_dialect: str
    exact: dict[str, str] = field(default_factory=dict)
    parameterized: dict[str, list[ParamRule]] = field(default_factory=dict)
    by_name: list[NameRule] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)

    def resolve(self, c: ColumnSpec) -> str:
        """Target type text for one column."""
        override = next((r.target for r in self.by_name if r.accepts(c)), None)
        return self.map_type(c) if override is None else override

    def map_type(self, c: ColumnSpec) -> str:
        name = c.type_name.upper()
        forced = {k.upper(): v for k, v in self.overrides.items()}.get(name)
        if forced is not None:
            return _fill(forced, c)
        rule = next((r for r in self.parameterized.get(name, []) if r.accepts(c)), None)
        return _fill(rule.target if rule else self.exact.get(name, c.type_name), c)

    def apply(self, table: TableSpec) -> TableSpec:
        """The same table with every column retyped for the target dialect."""
        return TableSpec(
            schema=table.schema,
            name=table.name,
            columns=tuple(self._retype(c) for c in table.columns),
            dialect=self.target_dialect,
            primary_key=table.primary_key,
            unique_keys=table.unique_keys,
            foreign_keys=table.foreign_keys,
        )

    def _retype(self, c: ColumnSpec) -> ColumnSpec:
        name, args = split_type(self.resolve(c))
        numeric = logical_type(self.target_dialect, name, 1, 38, 1).base == "NUMERIC"
        return ColumnSpec(
            name=c.name,
            type_name=name,
            length=0 if numeric else (args[0] if args else 0),
            precision=args[0] if numeric and args else 0,
            scale=args[1] if numeric and len(args) > 1 else 0,
            nullable=c.nullable,
            ordinal=c.ordinal,
            enum_values=c.enum_values,
            length_in_bytes=c.length_in_bytes,
        )


def _fill(target: str, c: ColumnSpec) -> str:
    """Put length, precision and scale in place of %l, %p and %s; a length that is not given leaves no brackets."""
    given = {"%l": str(c.length) if c.length > 0 else "", "(%l)": f"({c.length})" if c.length > 0 else "", "%p": str(c.precision), "%s": str(c.scale)}
    return re.sub(r"\(%l\)|%[lps]", lambda found: given[found[0]], target)


def split_type(text: str) -> tuple[str, list[int]]:
    """`DECIMAL(7,2)` -> ("DECIMAL", [7, 2])."""
    match = re.fullmatch(r"\s*([^()]+?)\s*(?:\(([\d,\s]*)\))?\s*", text)
    if match is None:
        raise ValueError(f"cannot read type {text!r}")
    args = [int(a) for a in (match.group(2) or "").split(",") if a.strip()]
    return match.group(1).upper(), args
