"""Pages, row numbers, sequences, projections."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.operators import numbering as N
from ferrywright.sources import paging as P
from ferrywright.spec import ColumnSpec, TableSpec
from showcase.registry import Tables, query

ORDER_KEY = ["o_custkey", "o_orderkey"]


@query(
    "keyset_page",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
       WHERE (o_custkey, o_orderkey) > (40, 700) ORDER BY o_custkey, o_orderkey LIMIT 500""",
)
def keyset_page(t: Tables) -> DataFrame:
    page = P.keyset_page(t.orders, ORDER_KEY, 500, {"o_custkey": 40, "o_orderkey": 700})
    return page.select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "keyset_page_mixed_key",
    """SELECT o_orderdate, o_orderpriority, o_orderkey FROM orders
       WHERE (o_orderdate, o_orderpriority, o_orderkey) > (TIMESTAMP '1996-03-05', '3-MEDIUM', 12)
       ORDER BY o_orderdate, o_orderpriority, o_orderkey LIMIT 250""",
)
def keyset_page_mixed_key(t: Tables) -> DataFrame:
    last = {"o_orderdate": datetime.datetime(1996, 3, 5), "o_orderpriority": "3-MEDIUM", "o_orderkey": 12}
    return P.keyset_page(t.orders, list(last), 250, last).select(*last)


@query(
    "first_page",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey LIMIT 500",
)
def first_page(t: Tables) -> DataFrame:
    return P.keyset_page(t.orders, ORDER_KEY, 500).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "rows_after_key",
    """SELECT count(*) AS n, min(o_orderkey) AS lowest, max(o_custkey) AS highest FROM orders
       WHERE (o_custkey, o_orderkey) > (40, 700)""",
)
def rows_after_key(t: Tables) -> DataFrame:
    rest = t.orders.filter(P.after_key(t.orders, {"o_custkey": 40, "o_orderkey": 700}))
    return rest.agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lowest"), F.max("o_custkey").alias("highest")
    )


@query(
    "offset_page",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 300 OFFSET 900",
)
def offset_page(t: Tables) -> DataFrame:
    return P.offset_page(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 300, 900)


@query(
    "page_numbers",
    """SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_num,
              (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 500 AS page
       FROM orders""",
)
def page_numbers(t: Tables) -> DataFrame:
    numbered = N.number_rows(t.orders.select(*ORDER_KEY), ORDER_KEY, unique=True)
    return numbered.withColumn("page", N.page_of(500))


@query(
    "row_numbers_shared_key",
    """WITH n AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS rn FROM lineitem)
       SELECT l_returnflag, min(rn) AS lowest, max(rn) AS highest, count(DISTINCT rn) AS numbers
       FROM n GROUP BY l_returnflag""",
)
def row_numbers_shared_key(t: Tables) -> DataFrame:
    # Every key covers a third of the rows.
    numbered = N.number_rows(t.lineitem, ["l_returnflag"])
    return numbered.groupBy("l_returnflag").agg(
        F.min(N.ROW_NUMBER).alias("lowest"),
        F.max(N.ROW_NUMBER).alias("highest"),
        F.countDistinct(N.ROW_NUMBER).alias("numbers"),
    )


@query(
    "page_cursors",
    """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn FROM orders)
       SELECT (rn - 1) // 500 AS page, max((o_custkey, o_orderkey))[1] AS o_custkey,
              max((o_custkey, o_orderkey))[2] AS o_orderkey, count(*) AS rows
       FROM n GROUP BY 1""",
)
def page_cursors(t: Tables) -> DataFrame:
    return N.page_cursors(N.number_rows(t.orders.select(*ORDER_KEY), ORDER_KEY, unique=True), ORDER_KEY, 500)


@query(
    "sequence_keys",
    """WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
       SELECT c_custkey, 1000 + 10 * (rn - 1) AS plain_id,
              CASE WHEN rn <= 17 THEN 50 + 3 * (rn - 1) ELSE 1 + 3 * ((rn - 18) % 33) END AS cycled_id,
              CASE WHEN rn <= 5 THEN 9 - 2 * (rn - 1) ELSE 10 - 2 * ((rn - 6) % 5) END AS falling_id
       FROM n""",
)
def sequence_keys(t: Tables) -> DataFrame:
    numbered = N.number_rows(t.customer.select("c_custkey"), ["c_custkey"], unique=True)
    rn = F.col(N.ROW_NUMBER)
    return numbered.select(
        "c_custkey",
        N.sequence_value(rn, start=1000, increment=10).alias("plain_id"),
        N.sequence_value(rn, start=50, increment=3, min_value=1, max_value=99, cycle=True).alias("cycled_id"),
        N.sequence_value(rn, start=9, increment=-2, min_value=1, max_value=10, cycle=True).alias("falling_id"),
    )


@query(
    "sequence_exhausted",
    """WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
       SELECT c_custkey, 'SEQ_EXHAUSTED' AS reason, 'new_id' AS "column" FROM n WHERE rn > 90""",
)
def sequence_exhausted(t: Tables) -> DataFrame:
    keyed = N.assign_sequence(t.customer.select("c_custkey"), ["c_custkey"], "new_id", start=10, max_value=99)
    return N.exhausted(keyed, "new_id", ["c_custkey"])


@query(
    "identity_keys",
    """WITH o AS (SELECT o_orderkey AS source_key, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS id
                  FROM orders),
            top AS (SELECT max(id) AS m FROM o),
            g AS (SELECT source_key, row_number() OVER (ORDER BY source_key) AS rn FROM o WHERE id IS NULL)
       SELECT source_key, id FROM o WHERE id IS NOT NULL
       UNION ALL SELECT source_key, m + rn FROM g, top""",
)
def identity_keys(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("source_key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("id")
    )
    return N.fill_identity(rows, "id", ["source_key"])


@query(
    "identity_always",
    """SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS id FROM orders""",
)
def identity_always(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return N.replace_identity(rows, "id", ["o_orderdate", "o_orderkey"], start=100, increment=5).select(
        "o_orderkey", "id"
    )


@query(
    "identity_descending",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE -o_orderkey END AS id FROM orders),
            n AS (SELECT o_orderkey, id, row_number() OVER (PARTITION BY id IS NULL ORDER BY o_orderkey) AS rn,
                         row_number() OVER (ORDER BY o_orderkey) AS place FROM o)
       SELECT o_orderkey, -1 - 3 * (place - 1) AS always_id,
              coalesce(id, (SELECT least(min(id), 0) FROM o) - 2 * rn) AS default_id FROM n""",
)
def identity_descending(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", -F.col("o_orderkey")).alias("default_id"), F.lit(0).alias("always_id")
    )
    kept = N.fill_identity(rows, "default_id", ["o_orderkey"], increment=-2)
    return N.replace_identity(kept, "always_id", ["o_orderkey"], start=-1, increment=-3)


@query("row_ids", "SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def row_ids(t: Tables) -> DataFrame:
    tagged = N.add_row_id(t.lineitem.select("l_orderkey"))
    return tagged.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"))


NATION = TableSpec(
    "tpch",
    "nation",
    (
        ColumnSpec("N_REGIONKEY", "NUMBER", precision=4, ordinal=2),
        ColumnSpec("N_NAME", "VARCHAR2", length=25, ordinal=1),
        ColumnSpec("N_NATIONKEY", "NUMBER", precision=4, ordinal=3),
    ),
)


@query(
    "project_ordinal",
    'SELECT n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY", n_nationkey AS "N_NATIONKEY" FROM nation',
)
def project_ordinal(t: Tables) -> DataFrame:
    return P.project(t.nation, NATION)


@query("fold_identifiers", 'SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME" FROM customer')
def fold_identifiers(t: Tables) -> DataFrame:
    rows = P.fold_columns(t.customer.select("c_custkey", "c_name"), "goldendb-oracle")
    return rows


@query(
    "key_order",
    """SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey""",
)
def key_order(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey").orderBy(*ORDER_KEY)
