"""Landing files: `{schema}.{table}.csv`, a file or a folder of part files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions import values as V
from ferrywright.spec import TableSpec

CORRUPT = "_corrupt"
# Where a row stood: file, block in the file, position in the task that read the block.
POSITION = ("_file", "_block", "_pos")
# Path of the landing file or folder: schema up to the first dot, then the table.
_NAME = r"/([^/.]+)\.([^/]+?)\.csv(?:/[^/]*)?$"


@dataclass(frozen=True)
class CsvLayout:
    sep: str = ","
    quote: str = '"'
    header: bool = True
    null_marker: str = V.NULL_MARKER
    encoding: str = ""
    line_sep: str | None = None
    multi_line: bool = True
    escape: str = ""
    null_overrides: Mapping[str, str] = field(default_factory=dict)

    def marker_of(self, column: str) -> str:
        """Text that stands for NULL in one column."""
        return {k.lower(): m for k, m in self.null_overrides.items()}.get(column.lower(), self.null_marker)

    def read_options(self) -> dict[str, str]:
        options = {
            "sep": self.sep,
            "quote": self.quote,
            "escape": self.escape or self.quote,
            "header": str(self.header).lower(),
            "multiLine": str(self.multi_line).lower(),
            "ignoreLeadingWhiteSpace": "true",
            # A stray quote inside a quoted field belongs to the value.
            "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE",
            # Header names that differ from the columns asked for fail the read.
            "enforceSchema": "false",
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": CORRUPT,
            # A pruned parse does not notice short and long rows.
            "columnPruning": "false",
            "encoding": V.java_charset(self.encoding),
        }
        if self.line_sep and not self.multi_line:
            options["lineSep"] = self.line_sep
        elif self.line_sep not in (None, "\n", "\r\n", "\r"):
            raise ValueError("a line separator of its own needs multi_line=False")
        return options


def read_landing(
    spark: SparkSession,
    path: str,
    columns: Iterable[str],
    layout: CsvLayout = CsvLayout(),
    position: bool = False,
) -> DataFrame:
    """Rows of one landing table, every column text, plus `_corrupt` for misshapen rows.

    Empty fields stay empty and only the marker is NULL. Spark's CSV reader turns an
    empty field into NULL, so it keeps its default null value here and the difference is
    restored afterwards; misshapen rows keep their text in `_corrupt` and all-NULL columns.

    `position` adds columns that sort in file order. Rows of one block are read in order
    by one task, and files with embedded newlines are never split, so the order is exact.
    """
    names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = spark.read.schema(schema).options(**layout.read_options()).csv(path)
    out = texts_of(names, layout)
    # The NULL half keeps a value column in the scan: Spark refuses to read only `_corrupt`.
    first = F.col(_tick(names[0]))
    out.append(F.coalesce(F.col(CORRUPT), F.nullif(first, first)).alias(CORRUPT))
    if position:
        out += [
            F.col("_metadata.file_path").alias(POSITION[0]),
            F.col("_metadata.file_block_start").alias(POSITION[1]),
            F.monotonically_increasing_id().alias(POSITION[2]),
        ]
    return raw.select(*out)


def texts_of(names: Iterable[str], layout: CsvLayout) -> list[Column]:
    """The parsed fields as they are to be seen: the marker is NULL, an empty field is empty."""
    good = F.col(CORRUPT).isNull()
    return [
        F.when(good, V.marker_to_null(F.coalesce(F.col(_tick(n)), F.lit("")), layout.marker_of(n))).alias(n)
        for n in names
    ]


def read_table(
    spark: SparkSession, folder: str, table: TableSpec, layout: CsvLayout = CsvLayout(), position: bool = False
) -> DataFrame:
    """Landing rows of a declared table, matched by the names in the header line.

    The file may order its columns as it likes and leave some out, which are NULL then;
    a column nobody declared is an error.
    """
    path = f"{folder.rstrip('/')}/{table.landing_name}"
    declared = [c.name for c in table.ordered()]
    header = read_header(spark, path, layout) if layout.header else declared
    known = {h.lower(): h for h in header}
    unknown = [h for h in header if h.lower() not in {d.lower() for d in declared}]
    if unknown:
        raise ValueError(f"{path} has columns {table.full_name} does not declare: {unknown}")
    rows = read_landing(spark, path, header, layout, position)
    values = [
        F.col(_tick(known[d.lower()])).alias(d) if d.lower() in known else F.lit(None).cast("string").alias(d)
        for d in declared
    ]
    return rows.select(*values, *rows.columns[len(header) :])


def read_header(spark: SparkSession, path: str, layout: CsvLayout = CsvLayout()) -> list[str]:
    """Column names from the header line; no value is looked at."""
    options = layout.read_options() | {"header": "true", "inferSchema": "false"}
    options.pop("columnNameOfCorruptRecord")
    return spark.read.options(**options).csv(path).columns


def split_landing_name(path: Column) -> tuple[Column, Column]:
    """Schema and table of a landing path."""
    return F.regexp_extract(path, _NAME, 1), F.regexp_extract(path, _NAME, 2)


def landed_tables(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(schema, table) of the landing files of a folder, by their names alone."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in place.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(place)]
    found = [re.search(_NAME, f"/{n}") for n in names]
    return sorted((m[1], m[2]) for m in found if m)


def landing_rows(spark: SparkSession, folder: str, layout: CsvLayout = CsvLayout()) -> DataFrame:
    """All records of all landing tables in one scan, tagged with schema and table.

    Tables differ in width, so only the first field is parsed out; header lines are
    dropped per file.
    """
    options = layout.read_options()
    options.pop("columnNameOfCorruptRecord")
    raw = (
        spark.read.schema("first_field string")
        .options(**options)
        .option("enforceSchema", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    schema, table = split_landing_name(F.col("_metadata.file_path"))
    tagged = raw.select(schema.alias("schema"), table.alias("table"), "first_field")
    return tagged.filter(F.col("table") != "")


def landing_counts(spark: SparkSession, folder: str, layout: CsvLayout = CsvLayout()) -> DataFrame:
    """Tables found in a landing folder and their row counts."""
    return landing_rows(spark, folder, layout).groupBy("schema", "table").agg(F.count(F.lit(1)).alias("rows"))


def split_malformed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-shaped rows, and the misshapen ones with their original line."""
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.filter(F.col(CORRUPT).isNotNull()).select(
        F.lit("CSV_SHAPE").alias("reason"), F.col(CORRUPT).alias("value")
    )
    return good, bad


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
