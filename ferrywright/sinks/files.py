"""CSV, reject and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.functions import values as V
from ferrywright.operators.numbering import range_ordered
from ferrywright.operators.report import report_document
from ferrywright.sources.landing import CsvLayout


def as_text(df: DataFrame, layout: CsvLayout = CsvLayout()) -> DataFrame:
    """Every column as landing text: compact date-times, hex, marker for NULL."""
    texts = [(f.name, V.value_text(F.col(f.name), f.dataType)) for f in df.schema.fields]
    return df.select(*[V.null_to_marker(text, layout.marker_of(name)).alias(name) for name, text in texts])


def write_csv(
    df: DataFrame,
    path: str,
    layout: CsvLayout = CsvLayout(),
    order: Sequence[str] = (),
    newline: str | None = None,
    quote_all: bool = False,
    mode: str = "errorifexists",
) -> None:
    """A folder of CSV part files; with `order`, part files follow each other in key order."""
    rows = range_ordered(df, order) if order else df
    text = as_text(rows, layout)
    if newline is not None:
        text = text.select(*[V.newline_to(F.col(c), newline).alias(c) for c in text.columns])
    writer = text.write.mode(mode).options(
        sep=layout.sep,
        quote=layout.quote,
        escape=layout.escape or layout.quote,
        header=layout.header,
        emptyValue="",
        quoteAll=quote_all,
        encoding=V.java_charset(layout.encoding),
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    if layout.line_sep:
        writer = writer.option("lineSep", layout.line_sep)
    writer.csv(path)


def write_rejects(rejects: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rejects.write.mode(mode).parquet(path)


def write_report(counts: DataFrame, path: str, source: str, target: str, mode: str = "errorifexists") -> None:
    """The report of a run as JSON; one document, one entry per table."""
    report_document(counts, source, target).write.mode(mode).json(path)
