"""Comparing, merging and continuing loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.operators import reconcile as R
from ferrywright.plans.views import create_view, refresh_materialized
from ferrywright.session import scratch_path, stage
from ferrywright.sinks.tables import write_lake_table
from showcase.registry import Tables, query

KEY = ["o_orderkey"]


def loaded_before(t: Tables) -> DataFrame:
    """What an interrupted load left behind: orders up to 1998, their prices still rounded."""
    old = t.orders.filter(F.col("o_orderdate") < "1998-01-01")
    return old.withColumn("o_totalprice", F.floor("o_totalprice").cast("double"))


_OLD = "(SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders WHERE o_orderdate < '1998-01-01')"


@query("rows_remaining", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_orderdate < '1998-01-01'")
def rows_remaining(t: Tables) -> DataFrame:
    return R.remaining_rows(t.orders, loaded_before(t), KEY).select("o_orderkey", "o_totalprice")


@query(
    "resume_load",
    f"""SELECT o_orderkey, o_totalprice, o_orderstatus FROM {_OLD}
        UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE NOT o_orderdate < '1998-01-01'""",
)
def resume_load(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "resumed")
    write_lake_table(loaded_before(t), target)
    # The second round finds nothing left to load.
    for _ in range(2):
        loaded = t.spark.read.schema(t.orders.schema).parquet(target)
        write_lake_table(stage(R.remaining_rows(t.orders, loaded, KEY), "missing"), target)
    return t.spark.read.parquet(target).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "reload_partitions",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders""",
)
def reload_partitions(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "reloaded")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    write_lake_table(rows.withColumn("o_totalprice", F.lit(0.0)), target, ("o_orderstatus",))
    write_lake_table(rows, target, ("o_orderstatus",), reload=True)
    return t.spark.read.parquet(target).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "merge_runs",
    f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, o_totalprice FROM {_OLD} WHERE o_orderstatus <> 'F'""",
)
def merge_runs(t: Tables) -> DataFrame:
    newer = t.orders.filter(F.col("o_orderstatus") == "F")
    return R.merge_runs(loaded_before(t), newer, KEY).select("o_orderkey", "o_totalprice")


@query(
    "bag_difference",
    """SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem
       EXCEPT ALL SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity < 25""",
)
def bag_difference(t: Tables) -> DataFrame:
    names = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return R.bag_difference(t.lineitem.select(*names), t.lineitem.filter(F.col("l_quantity") < 25).select(*names))


_LEFT = "(SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')"
_RIGHT = "(SELECT c_custkey FROM customer WHERE c_acctbal >= 2000)"


@query(
    "reconcile_by_key",
    f"""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS source_rows,
               (SELECT count(*) FROM {_RIGHT}) AS target_rows,
               count(*) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NOT NULL) AS matched,
               count(*) FILTER (WHERE c_custkey IS NULL) AS missing,
               count(*) FILTER (WHERE o_custkey IS NULL) AS extra
        FROM {_LEFT} a FULL JOIN {_RIGHT} b ON o_custkey = c_custkey""",
)
def reconcile_by_key(t: Tables) -> DataFrame:
    source = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("custkey"))
    target = t.customer.filter(F.col("c_acctbal") >= 2000).select(F.col("c_custkey").alias("custkey"))
    return R.reconcile_by_key(source, target, ["custkey"])


@query(
    "differing_keys",
    f"""SELECT coalesce(o_custkey, c_custkey) AS custkey,
               CASE WHEN c_custkey IS NULL THEN 'target' ELSE 'source' END AS missing_in
        FROM {_LEFT} a FULL JOIN {_RIGHT} b ON o_custkey = c_custkey
        WHERE o_custkey IS NULL OR c_custkey IS NULL""",
)
def differing_keys(t: Tables) -> DataFrame:
    source = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("custkey"))
    target = t.customer.filter(F.col("c_acctbal") >= 2000).select(F.col("c_custkey").alias("custkey"))
    return R.differing_keys(source, target, ["custkey"])


@query(
    "reconcile_counts",
    """SELECT 'tpch' AS "schema", 'orders' AS "table", (SELECT count(*) FROM orders) AS source_rows,
              (SELECT count(*) FROM orders WHERE o_orderdate < '1998-01-01') AS target_rows, false AS equal""",
)
def reconcile_counts(t: Tables) -> DataFrame:
    return R.reconcile_counts(t.orders, loaded_before(t), "tpch", "orders")


@query(
    "join_ci",
    """SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON upper(n_name) = 'NATION_' || c_nationkey""",
)
def join_ci(t: Tables) -> DataFrame:
    left = t.customer.select(
        "c_custkey", "c_name", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("nation")
    )
    joined = R.join_ignoring_case(left, t.nation.select("n_name"), [("nation", "n_name")])
    return joined.select("c_custkey", "c_name", "n_name")


_VIEW = """SELECT c.c_custkey, c.c_name, c.c_acctbal, n.n_name
           FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 1000"""


@query("emp_dept_view", _VIEW.format(customer="customer", nation="nation"))
def emp_dept_view(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("migrated_customer")
    t.nation.createOrReplaceTempView("migrated_nation")
    return create_view(t.spark, "rich_customers", _VIEW.format(customer="migrated_customer", nation="migrated_nation"))


@query("emp_dept_mview", _VIEW.format(customer="customer", nation="nation"))
def emp_dept_mview(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("migrated_customer")
    t.nation.createOrReplaceTempView("migrated_nation")
    text = _VIEW.format(customer="migrated_customer", nation="migrated_nation")
    path = scratch_path(t.spark, "mview")
    refresh_materialized(t.spark, text, path)
    return refresh_materialized(t.spark, text, path)
