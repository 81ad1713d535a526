"""What a bad row does to the rest of its table: stop, skip or only log.

The order of rows matters for `stop` and for a limit on errors. It is given by columns
that identify a row: the key of a table, or the position columns of landing files. A
single column must not be NULL; a tuple may have NULLs, which come first. No row is
numbered for it: the place where a load ends is a single tuple, found by a minimum or a
top-n over the bad rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ferrywright.functions.predicates import literal
from ferrywright.operators.checks import CODES, REASONS


@dataclass(frozen=True)
class ErrorPolicy:
    """`stop`, `skip_row` or `log_only`; `max_errors` limits `skip_row`, 0 means no limit."""

    kind: str = "skip_row"
    max_errors: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("stop", "skip_row", "log_only"):
            raise ValueError(f"unknown error policy {self.kind!r}")

    @property
    def error_limit(self) -> int:
        """Number of errors that ends the load, 0 for never."""
        if self.kind == "stop":
            return 1
        return self.max_errors if self.kind == "skip_row" else 0


def place(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def is_bad() -> Column:
    return F.size(REASONS) > 0


def load_end(checked: DataFrame, policy: ErrorPolicy, order: Sequence[str]) -> Column | None:
    """Place of the bad row that ends the load, or None when the load runs through.

    A job of its own that returns one tuple; its readers then compare with a literal.
    """
    limit = policy.error_limit
    if not limit:
        return None
    bad = checked.filter(is_bad()).select(place(order).alias("_place"))
    if limit > 1:
        bad = bad.orderBy("_place").limit(limit)
    last, met = bad.agg((F.min if limit == 1 else F.max)("_place"), F.count(F.lit(1))).first()
    if met < limit:
        return None
    if len(order) == 1:
        return literal(last, checked.schema[order[0]].dataType)
    return F.struct(*[literal(v, checked.schema[n].dataType).alias(n) for n, v in zip(order, last)])


def rows_met(checked: DataFrame, order: Sequence[str], end: Column | None) -> DataFrame:
    """Rows the load gets to see: all of them, or those up to the row that ended it.

    The result keeps `reasons`; its clean rows are loaded, its bad rows are the errors
    that were met.
    """
    return checked if end is None else checked.filter(place(order) <= end)


def loaded_rows(checked: DataFrame, policy: ErrorPolicy, order: Sequence[str]) -> DataFrame:
    """The rows that reach the target."""
    met = rows_met(checked, order, load_end(checked, policy, order))
    return met.filter(~is_bad()).drop(REASONS)


def import_counts(
    checked: DataFrame, policy: ErrorPolicy, order: Sequence[str], schema: str, table: str
) -> DataFrame:
    """Expected, actual, skipped and error counts of one table."""
    return counts_until(checked, policy, order, load_end(checked, policy, order), schema, table)


def counts_until(
    checked: DataFrame, policy: ErrorPolicy, order: Sequence[str], end: Column | None, schema: str, table: str
) -> DataFrame:
    """The counts in one pass, given where the load ended.

    `stop` reports its one error and skips nothing; `skip_row` counts a bad row as both;
    `log_only` counts it as an error only.
    """
    met = F.lit(True) if end is None else place(order) <= end
    errors = F.count_if(met & is_bad())
    return checked.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(met & ~is_bad()).alias("actual"),
        (errors if policy.kind == "skip_row" else F.lit(0).cast("long")).alias("skipped"),
        errors.alias("errors"),
    ).select(F.lit(schema).alias("schema"), F.lit(table).alias("table"), "expected", "actual", "skipped", "errors")


@dataclass(frozen=True)
class ObservedLoad:
    """Rows that count themselves while they are written.

    `accepted` is what reaches the target. `counts` and `reasons` are known after it has
    been written or otherwise run through once, and wait for that; they cost no job.
    """

    accepted: DataFrame
    observation: Observation
    schema: str
    table: str

    def counts(self) -> DataFrame:
        """As `import_counts`."""
        seen = self.observation.get
        names = ("expected", "actual", "skipped", "errors")
        kinds = ", ".join(f"{n} long" for n in names)
        values = (self.schema, self.table, *(seen[n] for n in names))
        return self.accepted.sparkSession.createDataFrame([values], f"schema string, table string, {kinds}")

    def reasons(self) -> DataFrame:
        """(schema, table, reason, n): how many rows met each reason, for reasons that occurred."""
        seen = self.observation.get
        found = [(self.schema, self.table, code, seen[f"n_{code}"]) for code in CODES if seen[f"n_{code}"]]
        return self.accepted.sparkSession.createDataFrame(found, "schema string, table string, reason string, n long")


def observed_load(
    checked: DataFrame, policy: ErrorPolicy, order: Sequence[str], schema: str, table: str
) -> ObservedLoad:
    """The accepted rows of a checked table, counted by the job that writes them.

    The rows are observed where they are read, ahead of every filter. Write `accepted`
    as it is: behind a shuffle a repeated task would count its rows again. Under a policy
    that may end the load early, the place where it ends is still found by a job before.
    """
    end = load_end(checked, policy, order)
    met = F.lit(True) if end is None else place(order) <= end
    errors = F.count_if(met & is_bad())
    found = F.transform(REASONS, lambda r: r["reason"])
    observation = Observation()
    rows = checked.observe(
        observation,
        F.count(F.lit(1)).alias("expected"),
        F.count_if(met & ~is_bad()).alias("actual"),
        (errors if policy.kind == "skip_row" else F.count_if(F.lit(False))).alias("skipped"),
        errors.alias("errors"),
        *(F.count_if(met & F.array_contains(found, code)).alias(f"n_{code}") for code in CODES),
    )
    return ObservedLoad(rows.filter(met & ~is_bad()).drop(REASONS), observation, schema, table)
