"""Row integrity checks: what the target database would refuse, found set by set.

Every check contributes structs `(reason, column, value)` to the array column `reasons`.
Checks on a row alone share one projection. Checks across rows aggregate per key first,
so a frequent key is reduced before it moves, and attach their finding through
`keyed.attach_facts`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.dialects import column_type
from ferrywright.functions import values as V
from ferrywright.functions.predicates import all_present, conjunction, disjunction
from ferrywright.operators.conform import conform_value, target_refuses
from ferrywright.operators.keyed import HOT_ROWS, attach_facts
from ferrywright.session import stage
from ferrywright.sources.landing import CORRUPT
from ferrywright.spec import ColumnSpec, ForeignKey, LogicalType, TableSpec, spark_type

REASONS = "reasons"
# What a reason may say.
CODES = (
    "CSV_SHAPE", "NOT_NULL", "CAST", "PRECISION", "LENGTH", "BAD_HEX", "ENUM",
    "DUP_PK", "DUP_UNIQUE", "FK_ORPHAN", "TARGET",
)
REASON_TYPE = "array<struct<reason:string,column:string,value:string>>"


def no_reasons() -> Column:
    return F.array().cast(REASON_TYPE)


def reason(code: str, column: str, value: Column) -> Column:
    return F.struct(
        F.lit(code).alias("reason"), F.lit(column).alias("column"), value.cast("string").alias("value")
    )


# --- predicates on one value --------------------------------------------------------


def not_null_violation(c: Column) -> Column:
    return c.isNull()


def cast_failure(c: Column, logical: LogicalType) -> Column:
    return c.isNotNull() & conform_value(c, logical).isNull()


def length_overflow(c: Column, length: int, in_bytes: bool = False) -> Column:
    measured = F.octet_length(c) if in_bytes else F.char_length(c)
    return measured > F.lit(length)


def precision_overflow(c: Column, precision: int, scale: int) -> Column:
    """A number whose integer part is too long; extra fraction digits are only rounded."""
    exact = c.try_cast("decimal(38,10)")
    return (exact.isNotNull() | c.try_cast("double").isNotNull()) & c.try_cast(T.DecimalType(precision, scale)).isNull()


def invalid_hex(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike("^([0-9A-Fa-f]{2})*$")


def outside_domain(c: Column, domain: Iterable[str]) -> Column:
    return ~c.isin(list(domain))


# --- checks on one row ----------------------------------------------------------------


def _column_tests(
    c: ColumnSpec, logical: LogicalType, value: Column, typed: Column, required: bool
) -> list[tuple[Column, Column]]:
    """(condition, reason) for every declared property of one column.

    `value` is the text as it came, `typed` what it became; only values that did not
    become anything are looked at again.
    """
    tests = []
    dtype = spark_type(logical)
    failed = value.isNotNull() & typed.isNull()
    if required:
        tests.append((not_null_violation(value), reason("NOT_NULL", c.name, value)))
    if isinstance(dtype, T.BinaryType):
        tests.append((failed, reason("BAD_HEX", c.name, value)))
        if c.length > 0:
            tests.append((F.octet_length(typed) > c.length, reason("LENGTH", c.name, value)))
    elif isinstance(dtype, T.NumericType):
        too_large = _too_large(value, typed, dtype, logical)
        tests.append((too_large, reason("PRECISION", c.name, value)))
        tests.append((failed & ~too_large, reason("CAST", c.name, value)))
    elif not isinstance(dtype, T.StringType):
        tests.append((failed, reason("CAST", c.name, value)))
    if isinstance(dtype, T.StringType) and c.length > 0:
        tests.append((length_overflow(value, c.length, c.length_in_bytes), reason("LENGTH", c.name, value)))
    if c.enum_values:
        tests.append((outside_domain(value, c.enum_values), reason("ENUM", c.name, value)))
    return tests


def _too_large(value: Column, typed: Column, dtype: T.DataType, logical: LogicalType) -> Column:
    """A number, but too large for its declaration; text that is no number is not."""
    if isinstance(dtype, T.DecimalType):
        found = value.isNotNull() & typed.isNull() & value.try_cast("double").isNotNull()
    elif logical.precision > 0:
        # NUMBER(4) fits a short with room to spare; its own limit is 9999.
        limit = F.lit(10**logical.precision)
        inside = (typed >= limit) | (typed <= -limit)
        # What did not even fit the type may still be a number.
        outside = F.abs(value.try_cast("decimal(38,0)")) >= limit.cast("decimal(38,0)")
        found = F.when(typed.isNotNull(), inside).otherwise(outside)
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def collect_reasons(tests: Sequence[tuple[Column, Column]]) -> Column:
    """Array of the reasons that hold. A clean row costs the conditions only."""
    if not tests:
        return no_reasons()
    found = [F.when(cond, F.array(why)).otherwise(no_reasons()) for cond, why in tests]
    any_bad = F.coalesce(disjunction([F.coalesce(cond, F.lit(False)) for cond, _ in tests]), F.lit(False))
    return F.when(any_bad, F.concat(*found).cast(REASON_TYPE)).otherwise(no_reasons())


def check_rows(df: DataFrame, table: TableSpec, extra: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """Typed columns plus `reasons`; no shuffle. A column of the primary key is required.

    Text is parsed, and columns that have a type already are cast to the declared one.

    With a `target`, values that its types cannot hold are reasons as well.

    Values are cast in a first projection and tested in a second, so no cast is repeated
    by the tests. The optimizer keeps the two apart because the casts are used twice.
    """
    columns = table.ordered()
    logical = [column_type(table, c) for c in columns]
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    given = [kinds.get(c.name.lower(), T.StringType()) for c in columns]
    typed = [
        (conform_value(F.col(c.name), lt) if isinstance(dt, T.StringType) else F.col(c.name).try_cast(spark_type(lt))).alias(f"_typed{i}")
        for i, (c, lt, dt) in enumerate(zip(columns, logical, given))
    ]
    keyed = {k.lower() for k in table.primary_key}
    shaped = F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")
    both = df.select(*[F.col(c.name) for c in columns], *typed, shaped.alias("_shape"), *extra)

    tests = []
    for i, (c, lt) in enumerate(zip(columns, logical)):
        value = F.col(c.name) if isinstance(given[i], T.StringType) else V.value_text(F.col(c.name), given[i])
        tests += _column_tests(c, lt, value, F.col(f"_typed{i}"), not c.nullable or c.name.lower() in keyed)
        if isinstance(given[i], T.FractionalType) and isinstance(spark_type(lt), T.IntegralType):
            # The cast cuts a fraction off; text with one is refused as well.
            cut = F.col(f"_typed{i}").isNotNull() & (F.col(c.name) % 1 != 0)
            tests.append((cut, reason("PRECISION", c.name, value)))
        if target:
            refused = target_refuses(F.col(f"_typed{i}"), lt, target, not c.nullable or c.name.lower() in keyed)
            tests.append((refused, reason("TARGET", c.name, value)))
    # A misshapen row has no values to test.
    misshapen = F.array(reason("CSV_SHAPE", "", F.col("_shape"))).cast(REASON_TYPE)
    reasons = F.when(F.col("_shape").isNotNull(), misshapen).otherwise(collect_reasons(tests)).alias(REASONS)
    return both.select(*[F.col(f"_typed{i}").alias(c.name) for i, c in enumerate(columns)], *extra, reasons)


# --- checks across rows ----------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unique_index_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicates under a unique index: rows with a NULL in it never collide."""
    return duplicate_keys(df.filter(all_present(keys)), keys)


def orphan_keys(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Distinct foreign keys without a parent, and how many child rows carry each.

    The child is reduced to distinct keys before anything moves, so a key on a third of
    all rows is one row per task in the shuffle.
    """
    child_keys = child.filter(all_present(fk.columns)).groupBy(*fk.columns).agg(F.count(F.lit(1)).alias("n"))
    renamed = parent.select(*[F.col(r).alias(f"_ref{i}") for i, r in enumerate(fk.ref_columns)])
    on = conjunction([F.col(c) == F.col(f"_ref{i}") for i, c in enumerate(fk.columns)])
    return child_keys.join(renamed, on, "left_anti")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in `order`; the rest would be refused as duplicates.

    Keys are counted first, which a hash aggregate does without their rows. Only rows under
    keys that occur more than once are compared, by an aggregate instead of a window: every
    task keeps one row per key, so copies of a frequent key never meet.
    """
    repeated = stage(duplicate_keys(df, keys).select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(keys)]), "repeated")
    if repeated.isEmpty():
        return df
    # NULL keys count as equal, as in a grouping.
    same = conjunction([F.col(k).eqNullSafe(F.col(f"_d{i}")) for i, k in enumerate(keys)])
    several = df.join(repeated, same, "left_semi")
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[c for c in order if c not in keys], *rest)
    best = several.groupBy(*keys).agg(_first_in_order(row, df, keys, order, rest).alias("_row"))
    picked = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return df.join(repeated, same, "left_anti").unionByName(best.select(*picked))


def _first_in_order(row: Column, df: DataFrame, keys, order, rest) -> Column:
    ordered = [c for c in order if c not in keys]
    maps = [c for c in df.columns if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    if maps or not ordered:
        # Maps have no order; compare by the order columns only.
        return F.min_by(row, F.struct(*order))
    return F.min(row)


def mark_duplicates(
    checked: DataFrame, keys: Sequence[str], order: Sequence[str], code: str = "DUP_PK", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add a reason to every row but the first under each key.

    Only rows without other reasons compete: a row that is refused anyway does not
    occupy its key. `order` must tell rows with one key apart.
    """
    rows = checked.filter((F.size(REASONS) == 0) & all_present(keys))
    facts = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(_place(order)).alias("_first"))
        .filter(F.col("n") > 1)
    )
    marked = attach_facts(checked, facts, keys, F.col("_first"), "_first", "n", hot_rows, order)
    late = (F.size(REASONS) == 0) & F.col("_first").isNotNull() & (_place(order) > F.col("_first"))
    value = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return _append(marked, late, reason(code, ",".join(keys), value)).drop("_first")


def mark_existing(
    checked: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    code: str = "DUP_PK",
    hot_rows: int = HOT_ROWS,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Add a reason to rows whose key the target table already holds."""
    arriving = checked.filter(all_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    taken = arriving.join(target.select(*keys), list(keys), "left_semi")
    marked = attach_facts(checked, taken, keys, F.lit(True), "_taken", "n", hot_rows, spread_by)
    value = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return _append(marked, F.col("_taken").isNotNull(), reason(code, ",".join(keys), value)).drop("_taken")


def _place(order: Sequence[str]) -> Column:
    # A plain column keeps the aggregate hash-based.
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def mark_orphans(
    checked: DataFrame,
    parent: DataFrame,
    fk: ForeignKey,
    code: str = "FK_ORPHAN",
    hot_rows: int = HOT_ROWS,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Add a reason to rows whose foreign key has no parent."""
    orphans = orphan_keys(checked, parent, fk)
    marked = attach_facts(checked, orphans, fk.columns, F.lit(True), "_orphan", "n", hot_rows, spread_by)
    value = F.concat_ws("|", *[F.col(k).cast("string") for k in fk.columns])
    return _append(marked, F.col("_orphan").isNotNull(), reason(code, ",".join(fk.columns), value)).drop("_orphan")


def mark_places(checked: DataFrame, places: DataFrame, place: str, fk: ForeignKey, code: str = "FK_ORPHAN") -> DataFrame:
    """Add the reason of a missing parent to the rows in these places, each named once."""
    marked = checked.join(places.withColumn("_orphan", F.lit(True)), place, "left")
    value = F.concat_ws("|", *[F.col(k).cast("string") for k in fk.columns])
    marked = _append(marked, F.col("_orphan").isNotNull(), reason(code, ",".join(fk.columns), value))
    return marked.select(*checked.columns)


def apply_delete_rule(child: DataFrame, parent: DataFrame, fk: ForeignKey, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What remains of child rows whose parent is gone: SET NULL clears the key, CASCADE drops the row."""
    orphans = orphan_keys(child, parent, fk)
    marked = attach_facts(child, orphans, fk.columns, F.lit(True), "_orphan", "n", hot_rows)
    rule = fk.delete_rule.upper()
    if rule == "CASCADE":
        return marked.filter(F.col("_orphan").isNull()).drop("_orphan")
    if rule == "SET NULL":
        cleared = [
            F.when(F.col("_orphan").isNull(), F.col(c)).alias(c) if c in fk.columns else F.col(c)
            for c in child.columns
        ]
        return marked.select(*cleared)
    raise ValueError(f"delete rule {fk.delete_rule!r} changes no rows")


def _append(df: DataFrame, cond: Column, why: Column) -> DataFrame:
    more = F.concat(F.col(REASONS), F.array(why)).cast(REASON_TYPE)
    return df.withColumn(REASONS, F.when(F.coalesce(cond, F.lit(False)), more).otherwise(F.col(REASONS)))


# --- outcome ---------------------------------------------------------------------------


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(REASONS) == 0).drop(REASONS)


def rejects(checked: DataFrame, keys: Sequence[str], table: TableSpec) -> DataFrame:
    """One row per reason, with the key of the refused row as text."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return checked.filter(F.size(REASONS) > 0).select(
        F.lit(table.schema).alias("schema"),
        F.lit(table.name).alias("table"),
        key.alias("row_key"),
        F.inline(REASONS),
    )
