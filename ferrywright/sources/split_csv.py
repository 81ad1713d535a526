"""Landing CSV with line breaks inside fields, read by many tasks per file.

Spark's reader gives such a file to one task, because a line break says nothing about
where a record ends. It does once the quotes before it are known: a record ends at a line
break with an even number of quotes ahead of it in the file. So the lines are read from
splittable text, a first pass counts the quotes of each block, a running sum over the
blocks of a file says whether each begins inside a field, and a second pass puts the lines
of its blocks together to records. Only a record that crosses a block's end is moved.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrywright.functions import values as V
from ferrywright.sources.landing import CORRUPT, CsvLayout, read_header, texts_of

# What a piece of a record is: whole, or of one that the block before began or the next one ends.
_WHOLE, _HEAD, _REST = 0, 1, 2
_BLOCK = ("_file", "_start", "_length")


def read_landing_split(spark: SparkSession, path: str, columns: Iterable[str], layout: CsvLayout = CsvLayout()) -> DataFrame:
    """What `read_landing` returns for a multi-line layout, from many tasks per file.

    The quotes of the file must be balanced, as every writer that doubles or escapes them
    leaves them; a stray one would turn records inside out, and `read_landing` is the
    reader for such files. Text must be UTF-8. A carriage return before a record's line
    break belongs to the break. Blocks are told by their places: if the two passes were
    cut differently, because the cluster has changed in between, the read fails and can be
    repeated.
    """
    names = list(columns)
    if V.java_charset(layout.encoding).upper().replace("-", "") != "UTF8":
        raise ValueError(f"only UTF-8 can be split, not {layout.encoding}")
    if layout.header and [h.lower() for h in read_header(spark, path, layout)] != [n.lower() for n in names]:
        raise ValueError(f"the header of {path} is not {names}")
    records = _records(spark, path, layout).filter("record <> ''")
    if layout.header:
        records = records.filter("not first")
    options = layout.read_options() | {"header": "false", "multiLine": "true", "lineSep": layout.line_sep or "\n"}
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
    parsed = records.select(F.from_csv("record", F.lit(fields), options).alias("_row")).select("_row.*")
    return parsed.select(*texts_of(names, layout), F.col(CORRUPT))


def _records(spark: SparkSession, path: str, layout: CsvLayout) -> DataFrame:
    """(record, first): the text of each record, and whether it is the first of its file."""
    lines = spark.read.option("lineSep", layout.line_sep or "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
    )
    quotes = _quotes(F.col("value"), layout)
    counted = lines.groupBy(*_BLOCK).agg(F.sum(quotes).alias("_quotes"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    # A row per block: one for 128 MB of input with Spark's own settings.
    blocks = counted.select(*_BLOCK, (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1).alias("_inside"))
    odd = (quotes % 2 == 1).alias("_odd")
    joined = lines.select("*", odd).join(F.broadcast(blocks), list(_BLOCK), "left")
    inside = F.coalesce("_inside", F.raise_error(F.lit("the file was cut differently in the second pass; read it again")).cast("boolean"))
    carriage = (layout.line_sep or "\n") == "\n"

    def put_together(batches):
        block, inside, lines, begins = None, False, [], False
        out = []

        def emit(kind: int) -> None:
            text = line_sep.join(lines)
            if kind == _WHOLE and carriage and text.endswith("\r"):
                text = text[:-1]
            out.append((*block, kind, begins, text))

        def close() -> None:
            # A block that ends inside a field leaves the rest to the next one.
            if lines:
                emit(_REST if continued else _HEAD if inside else _WHOLE)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_file", "_start", "_inside", "_odd", "value")]
            for file, start, starts_inside, is_odd, line in zip(*columns):
                if (file, start) != block:
                    close()
                    block, inside, lines = (file, start), starts_inside, []
                    begins, continued = start == 0, starts_inside
                elif not inside:
                    emit(_REST if continued else _WHOLE)
                    lines, begins, continued = [], False, False
                lines.append(line)
                inside ^= is_odd
            yield _batch(out)
            out.clear()
        close()
        yield _batch(out)

    line_sep = layout.line_sep or "\n"
    schema = "_file string, _start long, kind int, first boolean, record string"
    pieces = joined.select("_file", "_start", inside.alias("_inside"), "_odd", "value").mapInArrow(put_together, schema)
    return pieces.filter(F.col("kind") == _WHOLE).select("record", "first").union(_joined(pieces, line_sep, carriage))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("_file", pa.string()), ("_start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _joined(pieces: DataFrame, line_sep: str, carriage: bool) -> DataFrame:
    """Records that cross blocks: at most two pieces of a block, brought together by their number in the file."""
    cut = pieces.filter(F.col("kind") != _WHOLE)
    # A block's rest comes before the head that it begins itself.
    order = Window.partitionBy("_file").orderBy("_start", F.desc("kind"))
    cut = cut.withColumn("_number", F.sum((F.col("kind") == _HEAD).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("_start", "record")))
    whole = cut.groupBy("_file", "_number").agg(parts.alias("_parts"), F.max("first").alias("first"))
    record = F.array_join("_parts.record", line_sep)
    if carriage:
        record = F.regexp_replace(record, "\r$", "")
    return whole.select(record.alias("record"), "first")


def _quotes(line: Column, layout: CsvLayout) -> Column:
    """Quotes of a line that open or close a field."""
    if layout.escape and layout.escape != layout.quote:
        # An escaped character is no quote.
        line = F.regexp_replace(line, f"\\Q{layout.escape}\\E.", "")
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(layout.quote), F.lit("")))
