"""What follows through the references of several tables until nothing changes.

Rows that are refused take the rows below them along, deleted rows cascade, and tables may
refer to each other in circles. Each round looks only at the keys that the round before
has lost; the rounds are as many as the longest chain. Only the columns of references are
read, and rows are named by their place. What is gone is taken out of a table when it has
become a fair share of it, so that a round moves what it finds, not all that is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.functions.predicates import all_present, conjunction
from ferrywright.operators.report import union_all
from ferrywright.session import discard, stage
from ferrywright.spec import ForeignKey, TableSpec

PLACE = "_place"
# A table is written anew without what is gone when that is this share of it, and what is gone is gathered from this many frames.
_SHARE, _GATHER = 0.25, 16
# What a delete rule does to the row that refers: the others forbid the deletion.
_CASCADE, _CLEAR, _FORBID = "CASCADE", "SET NULL", "NO ACTION"


@dataclass(frozen=True)
class Reference:
    """A foreign key between two of the tables, both by their names in lower case."""

    child: str
    parent: str
    number: int
    key: ForeignKey

    @property
    def rule(self) -> str:
        rule = self.key.delete_rule.upper()
        return rule if rule in (_CASCADE, _CLEAR) else _FORBID


def references(tables: Sequence[TableSpec]) -> list[Reference]:
    """The references among these tables; those to other tables are left out."""
    names = {t.full_name.lower() for t in tables}
    return [
        Reference(t.full_name.lower(), t.resolve(fk.ref_table), i, fk)
        for t in tables
        for i, fk in enumerate(t.foreign_keys)
        if t.resolve(fk.ref_table) in names
    ]


def circles(tables: Sequence[TableSpec]) -> list[list[TableSpec]]:
    """The tables in groups, each after the groups it refers to; a group of several is a circle."""
    above = {t.full_name.lower(): set() for t in tables}
    for r in references(tables):
        above[r.child].add(r.parent)
    reached = {}
    for name in above:
        seen, todo = set(), [name]
        while todo:
            for parent in above[todo.pop()] - seen:
                seen.add(parent)
                todo.append(parent)
        reached[name] = seen
    waiting, out = list(tables), []
    while waiting:
        names = {t.full_name.lower() for t in waiting}
        first = next(
            t for t in waiting
            if all(p == (n := t.full_name.lower()) or n in reached[p] for p in reached[t.full_name.lower()] & names)
        )
        name = first.full_name.lower()
        group = [t for t in waiting if t is first or (t.full_name.lower() in reached[name] and name in reached[t.full_name.lower()])]
        out.append(group)
        waiting = [t for t in waiting if t not in group]
    return out


def unsupported(tables: Sequence[TableSpec], rows: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """(place, number) per table of the rows that cannot stay because a parent is not among those that stay.

    `rows` has the rows of each table by its name in lower case, with a stored `PLACE`.
    number is that of the foreign key, one of several if several fail in one round. Rows
    that refer to each other in a circle support each other. A reference with SET NULL
    outlives a parent that goes, but needs one to begin with; NULL refers to nothing.
    """
    links = references(tables)
    left = {name: _Left(_reference_columns(name, rows[name], links)) for name in {r.child for r in links} | {r.parent for r in links}}
    orphans: dict[str, list[DataFrame]] = {name: [] for name in left}
    for r in links:
        keys = left[r.parent].rows.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(r.key.ref_columns)])
        children = left[r.child].rows.filter(all_present(r.key.columns))
        orphans[r.child].append(children.join(keys, _same(r), "left_anti").withColumn("_number", F.lit(r.number)))
    shared = _shared(links, left)
    new = _settled(orphans, left)
    while new:
        found: dict[str, list[DataFrame]] = {name: [] for name in left}
        for r in links:
            if r.parent in new and r.rule != _CLEAR:
                found[r.child].append(_referring(r, left, shared, new).withColumn("_number", F.lit(r.number)))
        new = _settled(found, left)
    discard(*[t.rows for t in left.values()])
    spark = next(iter(rows.values())).sparkSession
    none = spark.createDataFrame([], f"{PLACE} long, _number int")
    return {name: union_all(left[name].gone) if name in left and left[name].gone else none for name in rows}


@dataclass(frozen=True)
class Effects:
    """What a deletion does to one table: places that go, places whose foreign key `number` is cleared, and
    places of rows that forbid it because their reference neither cascades nor is cleared."""

    deleted: DataFrame
    cleared: DataFrame
    forbidding: DataFrame


def cascade_closure(
    tables: Sequence[TableSpec], rows: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame]
) -> dict[str, Effects]:
    """Everything that deleting these rows leads to, through all references, circles included.

    `deleted` has the places of the rows deleted first, by table. A row that goes is
    neither cleared nor forbidding, whichever round takes it. Nothing is changed here; a
    caller that meets forbidding rows drops the whole deletion, as a database would.
    """
    links = references(tables)
    spark = next(iter(rows.values())).sparkSession
    left = {name: _Left(_reference_columns(name, frame, links)) for name, frame in rows.items()}
    touched: dict[str, list[DataFrame]] = {name: [] for name in rows}
    start = {name: [left[name].rows.join(frame.select(PLACE), PLACE, "left_semi").withColumn("_number", F.lit(-1))] for name, frame in deleted.items()}
    shared = _shared(links, left)
    new = _settled(start, left)
    while new:
        found: dict[str, list[DataFrame]] = {name: [] for name in rows}
        for r in links:
            if r.parent not in new:
                continue
            below = _referring(r, left, shared, new).withColumn("_number", F.lit(r.number))
            if r.rule == _CASCADE:
                found[r.child].append(below)
            else:
                touched[r.child].append(stage(below.select(PLACE, "_number", F.lit(r.rule == _CLEAR).alias("_cleared")), "touched"))
        new = _settled(found, left)
    out = {}
    for name in rows:
        none = spark.createDataFrame([], "_place long, _number int, _cleared boolean")
        away = union_all([f.select(PLACE) for f in left[name].gone]) if left[name].gone else none.select(PLACE)
        met = union_all(touched[name]).distinct() if touched[name] else none
        met = met.join(away, PLACE, "left_anti")
        out[name] = Effects(away, met.filter("_cleared").drop("_cleared"), met.filter("not _cleared").drop("_cleared"))
    discard(*[t.rows for t in left.values()])
    return out


class _Left:
    """The references of a table's rows: `rows` as they were last written, `since` what has gone after that.

    `gone` has the (place, number) of all that went. The table is written anew without them
    each time a share of it has gone, so all writings together are a few times the table.
    """

    def __init__(self, rows: DataFrame):
        self.rows = stage(rows, "references")
        self.size = self.rows.count()
        self.lost, self.since, self.gone = 0, [], []

    def alive(self) -> DataFrame:
        return self.without_gone(self.rows)

    def without_gone(self, rows: DataFrame) -> DataFrame:
        return rows.join(union_all(self.since), PLACE, "left_anti") if self.since else rows

    def take(self, found: DataFrame, n: int) -> None:
        """Rows that have gone just now, none of them gone before."""
        self.gone.append(found.select(PLACE, "_number"))
        self.since.append(found.select(PLACE))
        self.lost += n
        if self.lost >= self.size * _SHARE:
            before, self.rows = self.rows, stage(self.alive(), "references")
            discard(before)
            self.size, self.lost, self.since = self.size - self.lost, 0, []
        elif len(self.since) > _GATHER:
            self.since = [stage(union_all(self.since), "gone")]


def _reference_columns(name: str, rows: DataFrame, links: Sequence[Reference]) -> DataFrame:
    """The place of each row with the columns by which it refers or is referred to."""
    used = [c for r in links if r.child == name for c in r.key.columns]
    used += [c for r in links if r.parent == name for c in r.key.ref_columns]
    unique = {c.lower(): c for c in used}
    return rows.select(PLACE, *unique.values())


def _same(r: Reference):
    return conjunction([F.col(c) == F.col(f"_r{i}") for i, c in enumerate(r.key.columns)])


def _shared(links: Sequence[Reference], left: Mapping[str, _Left]) -> set[tuple[str, tuple[str, ...]]]:
    """The tables and columns referred to of which several rows have one key."""
    out = set()
    for name, columns in {(r.parent, tuple(r.key.ref_columns)) for r in links}:
        keys = left[name].rows.filter(all_present(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        if not keys.filter("_n > 1").isEmpty():
            out.add((name, columns))
    return out


def _referring(r: Reference, left: Mapping[str, _Left], shared, new: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that refer to a key which the last round took away for good; they may be gone already."""
    names = [f"_r{i}" for i in range(len(r.key.ref_columns))]
    keys = [F.col(c).alias(n) for c, n in zip(r.key.ref_columns, names)]
    lost = new[r.parent].select(*keys).filter(all_present(names))
    if (r.parent, tuple(r.key.ref_columns)) in shared:
        # A key that another row still has is not lost.
        lost = lost.distinct().join(left[r.parent].alive().select(*keys), names, "left_anti")
    return left[r.child].rows.join(lost, _same(r), "left_semi")


def _settled(found: Mapping[str, list[DataFrame]], left: Mapping[str, _Left]) -> dict[str, DataFrame]:
    """What a round has found, each row once and not gone before; tables without a find are left out.

    All tables are looked at before any of them is written anew.
    """
    out = {}
    for name, frames in found.items():
        if not frames:
            continue
        together = union_all(frames)
        others = [c for c in together.columns if c not in (PLACE, "_number")]
        if len(frames) > 1:
            together = together.groupBy(PLACE, *others).agg(F.min("_number").alias("_number"))
        once = stage(left[name].without_gone(together), "found")
        n = once.count()
        if n:
            out[name] = (once, n)
    for name, (once, n) in out.items():
        left[name].take(once, n)
    return {name: once for name, (once, _) in out.items()}
