"""Refusals and deletions that travel along references, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ferrywright import ColumnSpec, ForeignKey, TableSpec
from ferrywright.operators import closure as K
from ferrywright.operators.policy import ErrorPolicy
from ferrywright.plans.migrate import from_tables, migrate_tables


def spec(name, *keys):
    columns = [ColumnSpec(c, "INTEGER") for c in ("id", "x", "y")]
    return TableSpec("S", name, tuple(columns), dialect="postgres", primary_key=("id",), foreign_keys=tuple(keys))


def fk(column, table, rule="NO ACTION"):
    return ForeignKey((column,), table, ("id",), rule)


def data(seed, names, n=40):
    rng = random.Random(seed)
    ref = lambda: rng.choice([None, *range(n + 1), *range(n)])
    return {f"s.{name}": [(k, i, ref(), ref()) for k, i in enumerate(range(n))] for name in names}


def frames(spark, rows):
    return {name: spark.createDataFrame(r, f"{K.PLACE} long, id int, x int, y int") for name, r in rows.items()}


def brute_unsupported(tables, rows):
    alive = {name: {r[0]: r for r in rs} for name, rs in rows.items()}
    links = K.references(tables)
    value = lambda r, c: r[{"id": 1, "x": 2, "y": 3}[c]]
    first = True
    while True:
        ids = {name: {value(r, "id") for r in rs.values()} for name, rs in alive.items()}
        out = {
            (link.child, p) for link in links if first or link.rule != "SET NULL"
            for p, r in alive[link.child].items()
            if value(r, link.key.columns[0]) is not None and value(r, link.key.columns[0]) not in ids[link.parent]
        }
        if not first:
            # A SET NULL reference needs its parent only to begin with.
            out = {(n, p) for n, p in out}
        if not out:
            return {name: sorted(set(r[0] for r in rows[name]) - set(rs)) for name, rs in alive.items()}
        for name, p in out:
            alive[name].pop(p, None)
        first = False


CIRCLE = [spec("a", fk("x", "B"), fk("y", "s.A")), spec("b", fk("x", "S.c"), fk("y", "a", "SET NULL")), spec("c", fk("x", "a"))]


@pytest.mark.parametrize("seed", range(3))
def test_unsupported_rows_like_brute_force(spark, seed):
    rows = data(seed, "abc")
    found = K.unsupported(CIRCLE, frames(spark, rows))
    assert {n: sorted(r[K.PLACE] for r in f.collect()) for n, f in found.items()} == brute_unsupported(CIRCLE, rows)


def test_a_circle_of_rows_supports_itself(spark):
    rows = {"s.a": [(0, 1, 1, None), (1, 2, 2, None)], "s.b": [(0, 1, 1, None), (1, 2, 9, None)], "s.c": [(0, 1, 1, None)]}
    tables = [spec("a", fk("x", "b")), spec("b", fk("x", "c")), spec("c", fk("x", "a"))]
    found = K.unsupported(tables, frames(spark, rows))
    assert {n: [r[K.PLACE] for r in f.collect()] for n, f in found.items()} == {"s.a": [1], "s.b": [1], "s.c": []}


def test_empty_tables_and_long_chains(spark):
    none = K.unsupported(CIRCLE, frames(spark, {"s.a": [], "s.b": [], "s.c": []}))
    assert all(f.count() == 0 for f in none.values())
    chain = [spec("a", fk("x", "a"))]
    rows = {"s.a": [(i, i, i - 1, None) for i in range(12)]}
    assert K.unsupported(chain, frames(spark, rows))["s.a"].count() == 12


def brute_cascade(tables, rows, deleted):
    links = K.references(tables)
    value = lambda r, c: r[{"id": 1, "x": 2, "y": 3}[c]]
    gone = {name: set(deleted.get(name, ())) for name in rows}
    while True:
        before = sum(map(len, gone.values()))
        lost = {n: {r[1] for r in rs if r[0] in gone[n]} - {r[1] for r in rs if r[0] not in gone[n]} for n, rs in rows.items()}
        for link in links:
            if link.rule == "CASCADE":
                gone[link.child] |= {r[0] for r in rows[link.child] if value(r, link.key.columns[0]) in lost[link.parent]}
        if sum(map(len, gone.values())) == before:
            break
    met = {"SET NULL": {n: set() for n in rows}, "NO ACTION": {n: set() for n in rows}}
    for link in links:
        if link.rule != "CASCADE":
            met[link.rule][link.child] |= {
                (r[0], link.number) for r in rows[link.child] if r[0] not in gone[link.child] and value(r, link.key.columns[0]) in lost[link.parent]
            }
    return {n: (sorted(gone[n]), sorted(met["SET NULL"][n]), sorted(met["NO ACTION"][n])) for n in rows}


@pytest.mark.parametrize("seed", range(3))
def test_cascades_like_brute_force(spark, seed):
    tables = [spec("a", fk("x", "b", "CASCADE"), fk("y", "a", "SET NULL")), spec("b", fk("x", "c", "CASCADE"), fk("y", "a")), spec("c", fk("x", "a", "cascade"))]
    rows = data(seed + 10, "abc")
    given = frames(spark, rows)
    found = K.cascade_closure(tables, given, {"s.a": given["s.a"].filter("id in (3, 17)"), "s.c": given["s.c"].filter("id = 5")})
    result = {
        n: (
            sorted(r[K.PLACE] for r in e.deleted.collect()),
            *(sorted((r[K.PLACE], r["_number"]) for r in f.collect()) for f in (e.cleared, e.forbidding)),
        )
        for n, e in found.items()
    }
    assert result == brute_cascade(tables, rows, {"s.a": {3, 17}, "s.c": {5}})


def test_groups_come_after_what_they_refer_to():
    tables = [spec("d", fk("x", "a"), fk("y", "d")), *CIRCLE, spec("e"), spec("f", fk("x", "d"), fk("y", "e"))]
    groups = [sorted(t.name for t in g) for g in K.circles(tables)]
    assert sorted(groups) == [["a", "b", "c"], ["d"], ["e"], ["f"]]
    assert groups.index(["a", "b", "c"]) < groups.index(["d"]) < groups.index(["f"]) and groups.index(["e"]) < groups.index(["f"])


def test_a_run_over_a_circle(spark):
    source = {"a": [(1, 1, None), (2, 2, None), (3, None, 2), (None, 1, 1)], "b": [(1, 1, None), (2, 9, None)], "c": [(1, 1, None), (1, 1, None)]}
    out = {}

    def keep(kind):
        return lambda rows, table: out.__setitem__((kind, table.name), rows.collect())

    read = from_tables(lambda table: spark.createDataFrame(source[table.name], "id int, x int, y int"))
    counts = migrate_tables(CIRCLE, read, keep("rows"), keep("rejects"), policy=ErrorPolicy("skip_row"))
    assert {k[1]: sorted(r.id for r in v) for k, v in out.items() if k[0] == "rows"} == {"a": [1], "b": [1], "c": [1]}
    assert {k[1]: sorted(r.reason for r in v) for k, v in out.items() if k[0] == "rejects"} == {
        "a": ["FK_ORPHAN", "FK_ORPHAN", "NOT_NULL"], "b": ["FK_ORPHAN"], "c": ["DUP_PK"]
    }
    assert counts.agg(F.sum("expected"), F.sum("actual")).first()[:] == (8, 3)


def test_what_is_gone_is_taken_out_of_the_tables(spark, monkeypatch):
    # A chain: each round takes one row, which refers to the one before.
    n, written = 6, []
    rows = {"s.a": [(k, k, k - 1 if k else 99, None) for k in range(n)]}
    plain = K.stage
    monkeypatch.setattr(K, "stage", lambda df, label: written.append(label) or plain(df, label))
    found = K.unsupported([spec("a", fk("x", "a"))], frames(spark, rows))
    assert sorted(r[K.PLACE] for r in found["s.a"].collect()) == list(range(n))
    assert written.count("references") > 2
