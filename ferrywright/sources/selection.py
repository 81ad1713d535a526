"""Which tables take part: include patterns, then exclusions, as one predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSelection:
    """An empty include list means every table."""

    include: tuple[str, ...] = ("*",)
    exclude_glob: tuple[str, ...] = ()
    exclude_regex: tuple[str, ...] = ()
    exclude_schemas: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()

    def predicate(self, schema: Column, table: Column) -> Column:
        full = F.concat(schema, F.lit("."), table)

        def any_of(tests: list[Column], default: bool) -> Column:
            return reduce(Column.__or__, tests) if tests else F.lit(default)

        included = any_of([_glob(full, g) | _glob(table, g) for g in self.include if g != "*"], True)
        if "*" in self.include:
            included = F.lit(True)
        excluded = any_of(
            [_glob(table, g) | _glob(full, g) for g in self.exclude_glob]
            + [table.rlike(r) | full.rlike(r) for r in self.exclude_regex]
            + [F.lower(schema).isin([s.lower() for s in self.exclude_schemas])] * bool(self.exclude_schemas)
            + [F.lower(full).isin([t.lower() for t in self.exclude_tables])] * bool(self.exclude_tables),
            False,
        )
        return included & ~excluded

    def chooses(self, schema: str, table: str) -> bool:
        """The same for one name, where a run decides which tables to read at all."""
        full = f"{schema}.{table}"

        def like(patterns: tuple[str, ...]) -> bool:
            return any(re.search(glob_regex(g), n) for g in patterns for n in (table, full))

        if self.include and "*" not in self.include and not like(self.include):
            return False
        return not (
            like(self.exclude_glob)
            or any(re.search(r, n) for r in self.exclude_regex for n in (table, full))
            or schema.lower() in {s.lower() for s in self.exclude_schemas}
            or full.lower() in {t.lower() for t in self.exclude_tables}
        )


def scope_selection(scope: str) -> TableSelection:
    """`schema:NAME`, `table:NAME`, `table:SCHEMA.NAME` or nothing for everything."""
    kind, _, name = scope.partition(":")
    if not scope:
        return TableSelection()
    if kind == "schema":
        return TableSelection(include=(f"{name}.*",))
    if kind == "table":
        return TableSelection(include=(name,))
    raise ValueError(f"cannot read scope {scope!r}")


def _glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def glob_regex(pattern: str) -> str:
    """Shell pattern as a regular expression for the whole name; `*` also spans dots."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        closing = pattern.find("]", i + 1) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif closing > 0:
            out.append(pattern[i : closing + 1])
            i = closing
        else:
            out.append(re.escape(ch))
        i += 1
    return f"^{''.join(out)}$"
