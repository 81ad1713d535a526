"""Finding, counting and storing differences without reading or moving whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.operators import checks as C
from ferrywright.operators import digest_tree as D
from ferrywright.operators import policy as P
from ferrywright.operators import sketches as K
from ferrywright.operators.collisions import duplicates_by_bitmap as by_bitmap
from ferrywright.operators.report import union_all
from ferrywright.plans.load import check_table, load_table
from ferrywright.session import scratch_path
from ferrywright.sinks import merge as M
from ferrywright.spec import ColumnSpec, TableSpec
from showcase.loading import _BAD, ORDERS, STEPS, in_credit, landed_orders
from showcase.registry import Tables, query

KEY = ["o_orderkey"]


@query(
    "merge_files",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 < 30 THEN o_totalprice ELSE floor(o_totalprice) END AS o_totalprice,
              o_orderstatus FROM orders WHERE o_orderkey % 1000 < 30 OR o_orderdate < '1998-01-01' AND o_orderkey % 1000 < 990""",
)
def merge_files(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    path = scratch_path(t.spark, "merged")
    old = rows.filter(F.col("o_orderdate") < "1998-01-01").withColumn("o_totalprice", F.floor("o_totalprice").cast("double"))
    M.create_files(old, path, KEY, file_rows=500)
    M.merge_files(rows.filter("o_orderkey % 1000 < 30"), path, KEY, deleted=rows.filter("o_orderkey % 1000 >= 990").select(*KEY))
    return M.read_files(t.spark, path).drop("o_orderdate")


def _gapped(t: Tables) -> DataFrame:
    """Orders as a load left them that lost a range of keys and some single ones."""
    return t.orders.filter("o_orderkey not between 300 and 333 and o_orderkey % 911 <> 7")


@query(
    "reconcile_tree",
    """SELECT o_orderkey, CASE WHEN o_orderkey < 40 THEN 'source' ELSE 'target' END AS missing_in FROM orders
       WHERE (o_orderkey BETWEEN 300 AND 333 OR o_orderkey % 911 = 7) AND o_orderkey >= 40
          OR o_orderkey < 40 AND NOT (o_orderkey % 911 = 7)""",
)
def reconcile_tree(t: Tables) -> DataFrame:
    source, target = t.orders.filter("o_orderkey >= 40"), _gapped(t)
    root = scratch_path(t.spark, "trees")
    D.build_tree(source, f"{root}/source", KEY, width=16)
    D.build_tree(target, f"{root}/target", KEY, width=16)
    return D.reconcile_tree(source, target, f"{root}/source", f"{root}/target", KEY, width=16)


@query("changed_rows_tree", "SELECT o_orderkey FROM orders WHERE o_totalprice <> floor(o_totalprice) AND o_orderkey % 500 < 20")
def changed_rows_tree(t: Tables) -> DataFrame:
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    price = F.when(F.col("o_orderkey") % 500 < 20, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice"))
    source, target = t.orders.select(*columns), t.orders.withColumn("o_totalprice", price).select(*columns)
    root = scratch_path(t.spark, "trees")
    D.build_tree(source, f"{root}/source", KEY, columns, width=16)
    D.build_tree(target, f"{root}/target", KEY, columns, width=16)
    return D.changed_rows(source, target, f"{root}/source", f"{root}/target", KEY, columns, width=16)


@query(
    "duplicates_by_bitmap",
    """SELECT 'line' AS kind, l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
       UNION ALL SELECT 'order', o_custkey, NULL, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1
       UNION ALL SELECT 'key', o_orderkey, NULL, count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1""",
)
def duplicates_by_bitmap(t: Tables) -> DataFrame:
    none = F.lit(None).cast("int")
    lines = by_bitmap(t.lineitem, ["l_orderkey", "l_linenumber"])
    orders, keys = by_bitmap(t.orders, ["o_custkey"]), by_bitmap(t.orders, KEY)
    return (
        lines.select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), "n")
        .union(orders.select(F.lit("order"), "o_custkey", none, "n"))
        .union(keys.select(F.lit("key"), "o_orderkey", none, "n"))
    )


@query(
    "counts_observed",
    f"""SELECT 'tpch' AS "schema", 'orders' AS "table", count(*) AS expected, count(*) FILTER (WHERE NOT {_BAD}) AS actual,
               count(*) FILTER (WHERE {_BAD}) AS skipped, count(*) FILTER (WHERE {_BAD}) AS errors FROM orders""",
)
def counts_observed(t: Tables) -> DataFrame:
    checked = check_table(landed_orders(t), ORDERS, STEPS, parents={"customer": in_credit(t)})
    load = P.observed_load(checked, P.ErrorPolicy("skip_row"), KEY, "tpch", "orders")
    load.accepted.select(*[c.name for c in ORDERS.ordered()]).write.parquet(scratch_path(t.spark, "observed"))
    return load.counts()


ACCOUNTS = TableSpec(
    "tpch",
    "customer",
    (ColumnSpec("c_custkey", "NUMBER", precision=18), ColumnSpec("c_acctbal", "NUMBER", precision=4), ColumnSpec("c_name", "VARCHAR2")),
    primary_key=("c_custkey",),
)


@query(
    "typed_fraction_rejects",
    """SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'PRECISION' AS reason, 'c_acctbal' AS "column" FROM customer
       WHERE c_acctbal <> floor(c_acctbal) OR abs(trunc(c_acctbal)) >= 10000""",
)
def typed_fraction_rejects(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_acctbal", "c_name")
    return load_table(rows, ACCOUNTS).rejects.select("row_key", "reason", "column").distinct()


@query(
    "profile_sketches",
    """SELECT 'l_orderkey' AS "column", count(*) AS rows, count(*) - count(l_orderkey) AS nulls, true AS distinct_ok, true AS median_ok, NULL AS most FROM lineitem
       UNION ALL SELECT 'l_quantity', count(*), count(*) - count(nullif(l_quantity, 7)), true, true, NULL FROM lineitem
       UNION ALL SELECT 'l_shipdate', count(*), 0, true, true, NULL FROM lineitem
       UNION ALL SELECT 'l_returnflag', count(*), 0, true, NULL,
                        (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM lineitem""",
)
def profile_sketches(t: Tables) -> DataFrame:
    """Sketches of two loads of files, merged, and measured against exact values."""
    columns = ["l_orderkey", "l_quantity", "l_shipdate", "l_returnflag"]
    rows = t.lineitem.select(*columns).withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))
    root = scratch_path(t.spark, "profiled")
    for part in ("l_returnflag = 'A'", "l_returnflag <> 'A'"):
        # As many files as the table has splits, so that tasks to sketch them grow with it.
        rows.filter(part).write.mode("append").parquet(f"{root}/rows")
        K.sketch_new_files(t.spark, f"{root}/rows", f"{root}/sketches")
    found = K.profile_of(K.merge_sketches(t.spark.read.parquet(f"{root}/sketches")), [0.5], top=1)
    exact = []
    for f in rows.schema.fields:
        number = K._number(F.col(f.name), f.dataType)
        estimate = found.filter(F.col("column") == f.name).select(F.get("quantiles", F.lit(0))).scalar()
        exact.append(
            rows.agg(
                F.lit(f.name).alias("column"), F.countDistinct(f.name).alias("truth"), F.count(number).alias("numbers"),
                F.count_if(number < estimate).alias("below"), F.count_if(number <= estimate).alias("upto"),
            )
        )
    near = F.abs(F.col("distinct") - F.col("truth")) <= K.DISTINCT_ERROR * F.col("truth")
    slack = K.RANK_ERROR * F.col("numbers")
    ranked = (F.col("below") - slack <= F.col("numbers") / 2) & (F.col("upto") + slack >= F.col("numbers") / 2)
    most = F.when(F.col("column") == "l_returnflag", F.get("frequent", F.lit(0))["item"])
    return found.join(union_all(exact), "column").select(
        "column", "rows", "nulls", near.alias("distinct_ok"), F.when(F.col("numbers") > 0, ranked).alias("median_ok"), most.alias("most")
    )
