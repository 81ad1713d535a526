"""Table specs from catalog files: columns, primary keys, foreign keys, unique indexes."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Row, SparkSession

from ferrywright.spec import ColumnSpec, ForeignKey, TableSpec


def load_specs(spark: SparkSession, folder: str, dialect: str = "oracle") -> dict[str, TableSpec]:
    """`SCHEMA.NAME` -> spec, from `columns.csv` and, where present, the key files.

    These files describe tables, one line per column, so reading them on the driver is
    bounded by the width of the catalog, not by any table's rows.
    """
    by_table: dict[tuple[str, str], list[Row]] = defaultdict(list)
    for row in _lines(spark, folder, "columns.csv"):
        by_table[(row["TABLE_SCHEMA"], row["TABLE_NAME"])].append(row)
    keys = _grouped(_lines(spark, folder, "primary_keys.csv", optional=True), "CONSTRAINT_NAME")
    foreign = _grouped(_lines(spark, folder, "foreign_keys.csv", optional=True), "CONSTRAINT_NAME")
    indexes = _grouped(_lines(spark, folder, "indexes.csv", optional=True), "INDEX_NAME")
    specs = {}
    for (schema, name), rows in by_table.items():
        spec = TableSpec(
            schema=schema,
            name=name,
            columns=tuple(_column(r) for r in rows),
            dialect=dialect,
            primary_key=next((_names(g) for g in keys[(schema, name)]), ()),
            unique_keys=tuple(_names(g) for g in indexes[(schema, name)] if g[0]["UNIQUENESS"] == "UNIQUE"),
            foreign_keys=tuple(_reference(g) for g in foreign[(schema, name)]),
        )
        specs[spec.full_name] = spec
    return specs


def _lines(spark: SparkSession, folder: str, file: str, optional: bool = False) -> list[Row]:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(f"{folder.rstrip('/')}/{file}", header=True, comment="#", multiLine=True).collect()
    except AnalysisException as error:
        if optional and "PATH_NOT_FOUND" in str(error):
            return []
        raise


def _grouped(rows: list[Row], name: str) -> dict[tuple[str, str], list[list[Row]]]:
    """Rows of one constraint or index together, by table."""
    groups: dict[tuple[str, str, str], list[Row]] = defaultdict(list)
    for row in rows:
        groups[(row["TABLE_SCHEMA"], row["TABLE_NAME"], row[name])].append(row)
    out: dict[tuple[str, str], list[list[Row]]] = defaultdict(list)
    for (schema, table, _), members in groups.items():
        out[(schema, table)].append(members)
    return out


def _names(rows: list[Row]) -> tuple[str, ...]:
    return tuple(r["COLUMN_NAME"] for r in sorted(rows, key=lambda r: _int(r, "ORDINAL_POSITION")))


def _reference(rows: list[Row]) -> ForeignKey:
    first = rows[0]
    return ForeignKey(
        columns=tuple(r["COLUMN_NAME"] for r in rows),
        ref_table=f"{first['REF_SCHEMA']}.{first['REF_TABLE']}",
        ref_columns=tuple(r["REF_COLUMN"] for r in rows),
        delete_rule=first["DELETE_RULE"] or "NO ACTION",
    )


def _column(row: Row) -> ColumnSpec:
    fields = row.asDict()
    enum = fields.get("ENUM_VALUES") or ""
    precision = _int(row, "DATA_PRECISION")
    return ColumnSpec(
        name=row["COLUMN_NAME"],
        type_name=row["DATA_TYPE"],
        # Numbers report their storage size as length.
        length=0 if precision else _int(row, "DATA_LENGTH"),
        precision=precision,
        scale=_int(row, "DATA_SCALE"),
        nullable=(fields.get("NULLABLE") or "YES").upper() != "NO",
        ordinal=_int(row, "ORDINAL_POSITION"),
        enum_values=tuple(v.strip().strip("'") for v in enum.split(",") if v.strip()),
        length_in_bytes=(fields.get("CHAR_USED") or "").upper() in ("B", "BYTE"),
    )


def _int(row: Row, name: str) -> int:
    value = row.asDict().get(name)
    return int(value) if value not in (None, "") else 0
