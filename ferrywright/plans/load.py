"""One table from landing text to accepted rows, rejects and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.dialects import column_type, takes_numeric_booleans
from ferrywright.functions import values as V
from ferrywright.functions.predicates import all_present, conjunction
from ferrywright.operators import checks
from ferrywright.operators.conform import for_target
from ferrywright.operators.policy import ErrorPolicy, counts_until, load_end, rows_met
from ferrywright.operators.report import union_all
from ferrywright.session import discard, stage
from ferrywright.spec import ColumnSpec, ForeignKey, TableSpec, spark_type


@dataclass(frozen=True)
class Transforms:
    """Value steps of an import, applied in this order to every text column."""

    null_marker: str | None = V.NULL_MARKER
    null_if: tuple[str, ...] = ()
    null_words: tuple[str, ...] = ()
    null_words_case_sensitive: bool = True
    null_regex: str | None = None
    trim: bool = False
    datetime_format: str = ""
    datetime_fallbacks: tuple[str, ...] = ()
    truncate_datetimes: bool = False
    boolean_words: Mapping[str, bool] = field(default_factory=dict)
    empty_is_null: bool = False
    # Where the rows go: what it cannot hold is refused, the rest is stored in its types.
    target: str = "postgres"

    def apply(self, c: Column, column: ColumnSpec, table: TableSpec) -> Column:
        logical = column_type(table, column)
        dtype = spark_type(logical)
        # The marker is compared with the value as it came.
        out = c if self.null_marker is None else V.marker_to_null(c, self.null_marker)
        if isinstance(dtype, T.BinaryType):
            # Hex is decoded from the value as it came, too.
            return out
        if self.null_if:
            out = V.null_if(out, self.null_if)
        if self.null_words or self.null_regex:
            out = V.null_identifiers(out, self.null_words, self.null_words_case_sensitive, self.null_regex)
        if self.trim:
            out = V.trim_text(out)
        if not isinstance(dtype, T.NumericType):
            # A number of 14 digits is a number.
            if self.datetime_format == V.COMPACT_DATETIME:
                out = V.expand_datetime(out)
            elif self.datetime_format == V.COMPACT_DATE:
                out = V.expand_date(out)
        if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
            out = self._datetime(out, dtype)
        if logical.base == "BOOLEAN":
            if self.boolean_words:
                out = F.coalesce(V.map_boolean(out, self.boolean_words).cast("string"), out)
            elif takes_numeric_booleans(self.target):
                out = V.boolean_to_bit(out)
        if self.empty_is_null:
            out = V.empty_to_null(out)
        return out

    def _datetime(self, c: Column, dtype: T.DataType) -> Column:
        if self.datetime_fallbacks:
            # What already casts stays; unreadable text is kept for the cast check to report.
            parsed = V.parse_datetime(c, self.datetime_fallbacks).cast("string")
            c = F.coalesce(F.when(c.try_cast("timestamp_ntz").isNotNull(), c), parsed, c)
        if self.truncate_datetimes:
            unit = "day" if isinstance(dtype, T.DateType) else "second"
            cut = V.truncate_datetime(c.try_cast("timestamp_ntz"), unit).cast("string")
            c = F.coalesce(cut, c)
        return c


# Where a row stands in the staged table: unique and stored, so it stays the same for all readers.
PLACE = "_place"


@dataclass(frozen=True)
class LoadResult:
    """`accepted` has the declared types, in which keys are compared, `stored` the same rows as the target stores them."""

    checked: DataFrame
    accepted: DataFrame
    rejects: DataFrame
    counts: DataFrame
    stored: DataFrame


def transform(df: DataFrame, table: TableSpec, steps: Transforms) -> DataFrame:
    """Text in, text out: the value steps on every declared column of text, other columns kept."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    declared = {c.name.lower(): c for c in table.columns}
    return df.select(
        *[
            steps.apply(F.col(n), declared[n.lower()], table).alias(n) if n.lower() in declared and n in texts else F.col(n)
            for n in df.columns
        ]
    )


def check_table(
    text: DataFrame,
    table: TableSpec,
    steps: Transforms = Transforms(),
    parents: Mapping[str, DataFrame] | None = None,
    order: Sequence[str] = (),
    existing: DataFrame | None = None,
    check_parents: bool = True,
    held: Mapping[tuple[str, ...], DataFrame] | None = None,
    store: bool = False,
) -> DataFrame:
    """Typed columns, `order` columns, `reasons` and `_place` for every landing row.

    The text is parsed and tested once: the typed rows are staged, and the checks across
    rows come back for the columns they need. Their findings are staged as well, so that
    readers of the result join them once, and not at all where nothing was found; with
    `store` the joined rows are staged, for results that several readers read whole. `_place`
    is stored with them and tells even exact copies apart; `order` says how the rows
    arrived, without it they count as arriving in that place. `existing` are the rows an
    append will meet in the target; `held` has the keys of such rows by the names of their
    columns in lower case, and is looked at first. A row below a refused row of
    the same table is refused as well, unless the reference's rule is SET NULL. A foreign key needs its parent rows, unless
    `check_parents` says that it is not to be checked.
    """
    extra = [c for c in order if c.lower() not in {x.name.lower() for x in table.columns}]
    staged = checks.check_rows(transform(text, table, steps), table, extra, steps.target)
    staged = stage(staged.withColumn(PLACE, F.monotonically_increasing_id()), "checked")
    # Checks across rows work on keys and places; what they find is stored once and brought to the rows.
    keys = [c for k in (table.primary_key, *table.unique_keys, order) for c in k]
    keys += [c for fk in table.foreign_keys for c in (*fk.columns, *fk.ref_columns)]
    used = {c.lower() for c in (*keys, PLACE, checks.REASONS)}
    rows = staged.select(*[c for c in staged.columns if c.lower() in used])
    to_itself = []

    def there(keys: Sequence[str]) -> DataFrame | None:
        found = (held or {}).get(tuple(k.lower() for k in keys))
        if found is None and existing is not None and {k.lower() for k in keys} <= {c.lower() for c in existing.columns}:
            found = existing.select(*keys)
        return found

    given = {table.resolve(name): parent for name, parent in (parents or {}).items()}
    for fk in table.foreign_keys:
        parent = given.get(table.resolve(fk.ref_table))
        if parent is None and table.resolve(fk.ref_table) == table.full_name.lower():
            before = there(fk.ref_columns)
            # SET NULL says that a row outlives its parent.
            if fk.delete_rule.upper() != "SET NULL":
                to_itself.append((fk, before))
            own = staged.select(*fk.ref_columns)
            parent = own if before is None else own.union(before)
        if parent is None and check_parents:
            raise ValueError(f"{table.full_name} refers to {fk.ref_table}, whose rows are not given")
        if parent is not None:
            rows = checks.mark_orphans(rows, parent, fk, spread_by=[PLACE])
    if table.primary_key:
        if there(table.primary_key) is not None:
            rows = checks.mark_existing(rows, there(table.primary_key), table.primary_key, spread_by=[PLACE])
        rows = checks.mark_duplicates(rows, table.primary_key, [*order, PLACE])
    for unique in table.unique_keys:
        if there(unique) is not None:
            rows = checks.mark_existing(rows, there(unique), unique, spread_by=[PLACE], code="DUP_UNIQUE")
        rows = checks.mark_duplicates(rows, unique, [*order, PLACE], code="DUP_UNIQUE")
    for fk, before in to_itself:
        rows = _mark_below_refused(rows, fk, before)
    found = stage(rows.filter(F.size(checks.REASONS) > 0).select(PLACE, checks.REASONS), "found")
    if found.isEmpty():
        return staged.withColumn(checks.REASONS, checks.no_reasons())
    reasons = F.coalesce(checks.REASONS, checks.no_reasons()).cast(checks.REASON_TYPE).alias(checks.REASONS)
    # A row per bad row: broadcast where that is measured small.
    joined = staged.drop(checks.REASONS).join(found, PLACE, "left")
    whole = joined.select(*[reasons if c == checks.REASONS else F.col(c) for c in staged.columns])
    if not store:
        return whole
    out = stage(whole, "joined")
    discard(staged, found)
    return out


def _mark_below_refused(rows: DataFrame, fk: ForeignKey, held: DataFrame | None) -> DataFrame:
    """Refuse rows that refer to refused rows of their own table, and those that refer to these.

    A round per step of the longest chain that is refused, over keys only.
    """
    rows = stage(rows, "marked")
    child, ref = [f"_c{i}" for i in range(len(fk.columns))], [f"_r{i}" for i in range(len(fk.columns))]
    clean = rows.filter(F.size(checks.REASONS) == 0)
    left = clean.select(
        PLACE, *[F.col(c).alias(a) for c, a in zip(fk.columns, child)], *[F.col(c).alias(a) for c, a in zip(fk.ref_columns, ref)]
    )
    left, refused = stage(left, "references"), []
    while True:
        keys = left.select(*ref) if held is None else left.select(*ref).union(held)
        on = conjunction([F.col(c) == F.col(r) for c, r in zip(child, ref)])
        below = left.filter(all_present(child)).drop(*ref).join(keys, on, "left_anti")
        below = stage(below.select(PLACE), "below_refused")
        if below.isEmpty():
            break
        refused.append(below)
        left = stage(left.join(below, PLACE, "left_anti"), "references")
    if not refused:
        return rows
    return checks.mark_places(rows, union_all(refused), PLACE, fk)


def load_table(
    text: DataFrame,
    table: TableSpec,
    steps: Transforms = Transforms(),
    policy: ErrorPolicy = ErrorPolicy(),
    parents: Mapping[str, DataFrame] | None = None,
    order: Sequence[str] = (),
    existing: DataFrame | None = None,
    check_parents: bool = True,
    store: bool = False,
) -> LoadResult:
    """Split landing rows into accepted rows and rejects under an error policy; `store` is that of `check_table`."""
    checked = check_table(text, table, steps, parents, order, existing, check_parents, store=store)
    return settle(checked, table, policy, order, steps.target)


def settle(
    checked: DataFrame, table: TableSpec, policy: ErrorPolicy, order: Sequence[str] = (), target: str = "postgres"
) -> LoadResult:
    """The outcome of a checked table under a policy."""
    # Compared as a tuple, so a row without a key has its place as well.
    place = [*(order or table.primary_key), PLACE]
    end = load_end(checked, policy, place)
    seen = rows_met(checked, place, end)
    names = [c.name for c in table.ordered()]
    accepted = checks.accepted(seen).select(*names)
    return LoadResult(
        checked=checked,
        accepted=accepted,
        stored=for_target(accepted, table, target),
        rejects=checks.rejects(seen, table.primary_key or order or [PLACE], table),
        counts=counts_until(checked, policy, place, end, table.schema, table.name),
    )

