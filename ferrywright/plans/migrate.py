"""Several tables in one run: landing files or scans to targets, rejects and a report."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ferrywright.operators.checks import REASONS, mark_places
from ferrywright.operators.closure import circles, references, unsupported
from ferrywright.operators.policy import ErrorPolicy
from ferrywright.operators.report import COUNTS
from ferrywright.plans.load import PLACE, LoadResult, Transforms, check_table, load_table, settle
from ferrywright.session import run_scratch, stage
from ferrywright.sources.landing import CsvLayout, read_table
from ferrywright.sources.selection import TableSelection
from ferrywright.spec import TableSpec


def migrate_tables(
    tables: Iterable[TableSpec],
    read: Callable[[TableSpec], DataFrame],
    write: Callable[[DataFrame, TableSpec], None],
    write_rejects: Callable[[DataFrame, TableSpec], None],
    steps: Transforms = Transforms(),
    policy: ErrorPolicy = ErrorPolicy(),
    selection: TableSelection = TableSelection(),
) -> DataFrame:
    """Load the selected tables one after the other, referenced tables first; returns their counts.

    `read` delivers the text columns of a table, `write` stores its accepted rows in the
    types of `steps.target`. A selected table needs the tables it refers to. The
    rows accepted before are the parents later tables may refer to, so the children of a
    refused row are refused as well. Tables that refer to each other in a circle are
    checked one by one and then lose, all together, the rows whose parents are not among
    those that stay. Working tables are deleted at the end: `write` and `write_rejects` are
    to have written by the time they return.
    """
    parents: dict[str, DataFrame] = {}
    counts: list[Row] = []
    if getattr(read, "typed", False):
        # Values that never were text have no marker for NULL.
        steps = replace(steps, null_marker=None)
    chosen = [t for t in tables if selection.chooses(t.schema, t.name)]
    spark = SparkSession.active()
    with run_scratch(spark):
        for group in circles(chosen):
            for table, result in _load_group(group, read, steps, policy, parents):
                write(result.stored, table)
                write_rejects(result.rejects, table)
                counts += result.counts.collect()  # one row
                parents[table.full_name] = result.accepted
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return spark.createDataFrame(counts, f"schema string, table string, {kinds}")


def _load_group(
    group: list[TableSpec],
    read: Callable[[TableSpec], DataFrame],
    steps: Transforms,
    policy: ErrorPolicy,
    parents: dict[str, DataFrame],
) -> list[tuple[TableSpec, LoadResult]]:
    if len(group) == 1:
        return [(group[0], load_table(read(group[0]), group[0], steps, policy, parents, store=True))]
    inner = references(group)
    checked = {}
    for table in group:
        name = table.full_name.lower()
        own = {r.number for r in inner if r.child == name}
        outer = replace(table, foreign_keys=tuple(fk for i, fk in enumerate(table.foreign_keys) if i not in own))
        checked[name] = check_table(read(table), outer, steps, parents, store=True)
    refused = unsupported(group, {name: rows.filter(F.size(REASONS) == 0) for name, rows in checked.items()})
    out = []
    for table in group:
        name = table.full_name.lower()
        rows = checked[name]
        for r in inner:
            if r.child == name:
                places = refused[name].filter(F.col("_number") == r.number).select(PLACE)
                rows = mark_places(rows, places, PLACE, r.key)
        # Read as accepted rows, as rejects, for the counts and as parents.
        out.append((table, settle(stage(rows, "marked"), table, policy, target=steps.target)))
    return out


def by_reference(tables: Iterable[TableSpec]) -> list[TableSpec]:
    """The tables, each after those it refers to; a circle of references is an error."""
    waiting, out = list(tables), []
    while waiting:
        left = {t.full_name.lower() for t in waiting}
        ready = [
            t for t in waiting
            if not any(t.resolve(fk.ref_table) in left - {t.full_name.lower()} for fk in t.foreign_keys)
        ]
        if not ready:
            raise ValueError(f"tables refer to each other in a circle: {sorted(left)}")
        out += ready
        waiting = [t for t in waiting if t not in ready]
    return out


def from_landing(spark: SparkSession, folder: str, layout: CsvLayout = CsvLayout()) -> Callable[[TableSpec], DataFrame]:
    """Reader of `{schema}.{table}.csv` below a folder."""

    return lambda table: read_table(spark, folder, table, layout)


def from_tables(scan: Callable[[TableSpec], DataFrame]) -> Callable[[TableSpec], DataFrame]:
    """Reader of typed tables: their values stay as they are, no text lies in between."""

    def read(table: TableSpec) -> DataFrame:
        return scan(table).select(*[F.col(c.name).alias(c.name) for c in table.ordered()])

    read.typed = True
    return read
