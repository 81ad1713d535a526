"""Whole loads: landing text to accepted rows, rejects, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.functions import values as V
from ferrywright.operators import checks as C
from ferrywright.operators import policy as P
from ferrywright.operators import report as R
from ferrywright.operators.closure import PLACE, cascade_closure
from ferrywright.plans.load import Transforms, check_table, load_table
from ferrywright.plans.migrate import from_landing, from_tables, migrate_tables
from ferrywright.session import scratch_path, stage
from ferrywright.sinks.files import write_csv, write_rejects, write_report
from ferrywright.sinks.tables import write_lake_table
from ferrywright.spec import ColumnSpec, ForeignKey, TableSpec
from showcase.registry import Tables, query

ORDERS = TableSpec(
    "tpch",
    "orders",
    (
        ColumnSpec("o_orderkey", "NUMBER", precision=18, nullable=False),
        ColumnSpec("o_custkey", "NUMBER", precision=18, nullable=False),
        ColumnSpec("o_orderstatus", "CHAR", length=1),
        ColumnSpec("o_totalprice", "NUMBER", precision=8, scale=2),
        ColumnSpec("o_orderdate", "DATE"),
        ColumnSpec("o_orderpriority", "VARCHAR2", length=14),
    ),
    primary_key=("o_orderkey",),
    foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
)


def landed_orders(t: Tables) -> DataFrame:
    """Orders as an export would have written them, with defects taken from the data.

    Dates are compact, the customer of an urgent order without final state is missing, and
    orders above 499,000 carry a word instead of their price.
    """
    missing = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(missing, V.NULL_MARKER).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderstatus",
        F.when(F.col("o_totalprice") > 499000, "see contract").otherwise(price).alias("o_totalprice"),
        V.compact_datetime(F.col("o_orderdate")).alias("o_orderdate"),
        "o_orderpriority",
    )


STEPS = Transforms(trim=True, datetime_format=V.COMPACT_DATETIME)


def in_credit(t: Tables) -> DataFrame:
    """Customers that may be referred to."""
    return t.customer.filter(F.col("c_acctbal") >= 0)


_MISSING = "(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')"
_ORPHAN = f"(NOT {_MISSING} AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))"
_LONG = "(length(o_orderpriority) > 14)"
_WORD = "(o_totalprice > 499000)"
_BAD = f"({_MISSING} OR {_ORPHAN} OR {_LONG} OR {_WORD})"


@query(
    "load_orders",
    f"""SELECT 'tpch' AS "schema", 'orders' AS "table", count(*) AS expected,
               count(*) FILTER (WHERE NOT {_BAD}) AS actual, count(*) FILTER (WHERE {_BAD}) AS skipped,
               count(*) FILTER (WHERE {_BAD}) AS errors,
               CASE WHEN count(*) FILTER (WHERE {_BAD}) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status
        FROM orders""",
)
def load_orders(t: Tables) -> DataFrame:
    result = load_table(landed_orders(t), ORDERS, STEPS, parents={"customer": in_credit(t)})
    return R.with_status(result.counts)


@query(
    "load_orders_rows",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE NOT {_BAD}""",
)
def load_orders_rows(t: Tables) -> DataFrame:
    result = load_table(landed_orders(t), ORDERS, STEPS, parents={"customer": in_credit(t)})
    return result.accepted.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(
    "load_orders_rejects",
    f"""SELECT 'tpch' AS "schema", 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS row_key, reason, "column", value
        FROM (SELECT o_orderkey, 'NOT_NULL' AS reason, 'o_custkey' AS "column", NULL AS value FROM orders WHERE {_MISSING}
              UNION ALL SELECT o_orderkey, 'FK_ORPHAN', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE {_ORPHAN}
              UNION ALL SELECT o_orderkey, 'LENGTH', 'o_orderpriority', o_orderpriority FROM orders WHERE {_LONG}
              UNION ALL SELECT o_orderkey, 'CAST', 'o_totalprice', 'see contract' FROM orders WHERE {_WORD})""",
)
def load_orders_rejects(t: Tables) -> DataFrame:
    return load_table(landed_orders(t), ORDERS, STEPS, parents={"customer": in_credit(t)}).rejects


LINES = TableSpec(
    "tpch",
    "lineitem",
    (
        ColumnSpec("l_orderkey", "BIGINT", nullable=False),
        ColumnSpec("l_linenumber", "INT", nullable=False),
        ColumnSpec("l_partkey", "BIGINT"),
        ColumnSpec("l_suppkey", "BIGINT"),
        ColumnSpec("l_extendedprice", "DECIMAL", precision=12, scale=2),
        ColumnSpec("l_returnflag", "CHAR", length=1),
        ColumnSpec("l_shipdate", "DATETIME"),
    ),
    dialect="mysql",
    primary_key=("l_orderkey", "l_linenumber"),
)


@query(
    "load_lineitem",
    """SELECT 'tpch' AS "schema", 'lineitem' AS "table", count(*) AS expected,
              count(DISTINCT (l_orderkey, l_linenumber)) AS actual,
              count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS skipped,
              count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS errors
       FROM lineitem""",
)
def load_lineitem(t: Tables) -> DataFrame:
    text = t.lineitem.select(
        *[F.col(c.name).cast("string").alias(c.name) for c in LINES.columns if c.name != "l_extendedprice"],
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("l_extendedprice"),
    )
    return load_table(text, LINES, Transforms()).counts


CUSTOMERS = TableSpec(
    "tpch",
    "customer",
    (
        ColumnSpec("c_custkey", "BIGINT", nullable=False),
        ColumnSpec("c_name", "VARCHAR", length=25),
        ColumnSpec("c_mktsegment", "VARCHAR", length=9),
    ),
    dialect="mysql",
    primary_key=("c_custkey",),
)
RUN = (
    CUSTOMERS,
    TableSpec(
        "tpch",
        "orders",
        ORDERS.columns,
        primary_key=("o_orderkey",),
        foreign_keys=(ForeignKey(("o_custkey",), "tpch.customer", ("c_custkey",)),),
    ),
    TableSpec(
        "tpch",
        "lineitem",
        LINES.columns,
        dialect="mysql",
        foreign_keys=(ForeignKey(("l_orderkey",), "tpch.orders", ("o_orderkey",)),),
    ),
)
_NO_CUSTOMER = "(o_custkey IN (SELECT c_custkey FROM customer WHERE length(c_mktsegment) > 9))"
_BAD_ORDER = f"({_MISSING} OR {_NO_CUSTOMER} OR {_LONG} OR {_WORD})"
_RUN_COUNTS = """SELECT 'tpch' AS "schema", '{0}' AS "table", count(*) AS expected, count(*) FILTER (WHERE NOT {1}) AS actual,
    count(*) FILTER (WHERE {1}) AS skipped, count(*) FILTER (WHERE {1}) AS errors FROM {0}"""


@query(
    "migrate_tables",
    " UNION ALL ".join(
        [
            _RUN_COUNTS.format("customer", "(length(c_mktsegment) > 9)"),
            _RUN_COUNTS.format("orders", _BAD_ORDER),
            _RUN_COUNTS.format("lineitem", f"(l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_BAD_ORDER}))"),
        ]
    ),
)
def migrate(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "run")
    write_csv(t.customer.select(*[c.name for c in CUSTOMERS.columns]), f"{root}/in/tpch.customer.csv")
    write_csv(landed_orders(t), f"{root}/in/tpch.orders.csv")
    write_csv(t.lineitem.select(*[c.name for c in LINES.columns]), f"{root}/in/tpch.lineitem.csv")
    return migrate_tables(
        RUN,
        from_landing(t.spark, f"{root}/in"),
        lambda rows, table: write_lake_table(rows, f"{root}/out/{table.full_name}"),
        lambda rows, table: write_rejects(rows, f"{root}/rejects/{table.full_name}"),
        STEPS,
    )


# --- targets ---------------------------------------------------------------------------

WIDE = TableSpec(
    "tpch",
    "orders",
    (
        ColumnSpec("o_orderkey", "BIGINT"),
        ColumnSpec("is_final", "BOOLEAN"),
        ColumnSpec("big", "NUMERIC", precision=30),
        ColumnSpec("note", "VARCHAR", length=20),
        ColumnSpec("remark", "VARCHAR", length=20, nullable=False),
    ),
    dialect="postgres",
    primary_key=("o_orderkey",),
)


def wide_orders(t: Tables) -> DataFrame:
    """Landed orders with numbers of up to 20 digits and empty texts."""
    big = (F.round(F.col("o_totalprice") * 100).cast("decimal(12,0)") * F.lit(10**12).cast("decimal(13,0)")).cast("string")
    empty = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), (F.col("o_orderstatus") == "F").cast("string").alias("is_final"),
        big.alias("big"), empty.alias("note"), F.when(F.col("o_totalprice") < 2000, "").otherwise("ok").alias("remark"),
    )


@query(
    "load_to_oracle",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_final, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS note,
              NULL AS reason, NULL AS "column" FROM orders WHERE o_totalprice >= 2000
       UNION ALL SELECT o_orderkey, NULL, NULL, 'TARGET', 'remark' FROM orders WHERE o_totalprice < 2000""",
)
def load_to_oracle(t: Tables) -> DataFrame:
    # Oracle stores an empty text as NULL, which `remark` does not allow.
    result = load_table(wide_orders(t), WIDE, Transforms(target="oracle"))
    none = F.lit(None).cast("string")
    stored = result.stored.select("o_orderkey", F.col("is_final").cast("int").alias("is_final"), "note", none.alias("reason"), none.alias("column"))
    refused = result.rejects.select(F.col("row_key").cast("bigint"), none.cast("int"), none, "reason", "column")
    return stored.union(refused)


@query(
    "load_to_duckdb",
    """WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS HUGEINT) * 1000000000000 AS big FROM orders)
       SELECT o_orderkey, CAST(big AS VARCHAR) AS big, NULL AS reason FROM o WHERE big <= 9223372036854775807
       UNION ALL SELECT o_orderkey, CAST(big AS VARCHAR), 'TARGET' FROM o WHERE big > 9223372036854775807""",
)
def load_to_duckdb(t: Tables) -> DataFrame:
    # Unscaled numbers become BIGINT there.
    result = load_table(wide_orders(t), WIDE, Transforms(target="duckdb"))
    assert result.stored.schema["big"].dataType.simpleString() == "bigint"
    stored = result.stored.select("o_orderkey", F.col("big").cast("string").alias("big"), F.lit(None).cast("string").alias("reason"))
    return stored.union(result.rejects.select(F.col("row_key").cast("bigint"), "value", "reason"))


# --- circles and cascades ---------------------------------------------------------------

CIRCLE = (
    TableSpec(
        "shop",
        "customer",
        (
            ColumnSpec("c_custkey", "NUMBER", precision=18),
            ColumnSpec("c_mktsegment", "VARCHAR2", length=9),
            ColumnSpec("favourite", "NUMBER", precision=18),
        ),
        primary_key=("c_custkey",),
        foreign_keys=(ForeignKey(("favourite",), "ORDERS", ("o_orderkey",)),),
    ),
    TableSpec(
        "shop",
        "orders",
        (
            ColumnSpec("o_orderkey", "NUMBER", precision=18),
            ColumnSpec("o_custkey", "NUMBER", precision=18),
            ColumnSpec("o_orderpriority", "VARCHAR2", length=14),
        ),
        primary_key=("o_orderkey",),
        foreign_keys=(ForeignKey(("o_custkey",), "shop.customer", ("c_custkey",)),),
    ),
)
# Four of five customers have a favourite order, which need not be one of their own.
_FAVOURITE = "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 7 END"


@query(
    "fk_circle",
    f"""WITH RECURSIVE c AS (SELECT c_custkey, {_FAVOURITE} AS favourite, length(c_mktsegment) > 9 AS bad FROM customer),
        o AS (SELECT o_orderkey, o_custkey, length(o_orderpriority) > 14 AS bad FROM orders),
        edges AS (SELECT 'customer' AS kind, c_custkey AS id, 'orders' AS above, favourite AS parent FROM c
                  UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey FROM o),
        gone AS (
          SELECT 'customer' AS kind, c_custkey AS id FROM c
          WHERE bad OR favourite IS NOT NULL AND favourite NOT IN (SELECT o_orderkey FROM o)
          UNION ALL SELECT 'orders', o_orderkey FROM o WHERE bad OR o_custkey NOT IN (SELECT c_custkey FROM c)),
        spread AS (SELECT * FROM gone UNION SELECT e.kind, e.id FROM spread s JOIN edges e ON e.above = s.kind AND e.parent = s.id)
        SELECT 'shop' AS "schema", kind AS "table", n AS expected, n - lost AS actual, lost AS skipped, lost AS errors
        FROM (SELECT kind, count(*) AS lost FROM spread GROUP BY kind)
        JOIN (SELECT 'customer' AS kind, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o) USING (kind)""",
)
def fk_circle(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "circle")
    landed = {
        "customer": t.customer.select("c_custkey", "c_mktsegment", F.expr(_FAVOURITE).alias("favourite")),
        "orders": t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"),
    }
    return migrate_tables(
        CIRCLE,
        from_tables(lambda table: landed[table.name]),
        lambda rows, table: write_lake_table(rows, f"{root}/out/{table.full_name}"),
        lambda rows, table: write_rejects(rows, f"{root}/rejects/{table.full_name}"),
        policy=P.ErrorPolicy("skip_row"),
    )


_TREE = (
    TableSpec("shop", "nation", (ColumnSpec("n_nationkey", "INT"),)),
    TableSpec(
        "shop", "customer", (ColumnSpec("c_custkey", "INT"),),
        foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",), "CASCADE"), ForeignKey(("favourite",), "orders", ("o_orderkey",), "SET NULL")),
    ),
    TableSpec("shop", "orders", (ColumnSpec("o_orderkey", "INT"),), foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",), "CASCADE"),)),
    TableSpec("shop", "lineitem", (ColumnSpec("l_orderkey", "INT"),), foreign_keys=(ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),)),
)


@query(
    "cascade_closure",
    f"""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2),
             c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
             o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
        SELECT 'nation' AS "table", 'deleted' AS effect, count(*) AS n FROM n
        UNION ALL SELECT 'customer', 'deleted', count(*) FROM c
        UNION ALL SELECT 'orders', 'deleted', count(*) FROM o
        UNION ALL SELECT 'customer', 'cleared', count(*) FROM customer
                  WHERE {_FAVOURITE} IN (SELECT o_orderkey FROM o) AND c_custkey NOT IN (SELECT c_custkey FROM c)
        UNION ALL SELECT 'lineitem', 'forbidding', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
)
def cascade(t: Tables) -> DataFrame:
    rows = {
        "shop.nation": t.nation,
        "shop.customer": t.customer.withColumn("favourite", F.expr(_FAVOURITE)),
        "shop.orders": t.orders,
        "shop.lineitem": t.lineitem.select("l_orderkey"),
    }
    rows = {name: stage(frame.withColumn(PLACE, F.monotonically_increasing_id())) for name, frame in rows.items()}
    effects = cascade_closure(_TREE, rows, {"shop.nation": rows["shop.nation"].filter("n_regionkey = 2")})
    found = [
        frame.select(F.lit(name.split(".")[1]).alias("table"), F.lit(kind).alias("effect"))
        for name, e in effects.items()
        for kind, frame in (("deleted", e.deleted), ("cleared", e.cleared), ("forbidding", e.forbidding))
    ]
    return R.union_all(found).groupBy("table", "effect").agg(F.count(F.lit(1)).alias("n"))


# --- error policies -------------------------------------------------------------------

PRICED = TableSpec("tpch", "orders", ORDERS.columns[:5], primary_key=("o_orderkey",))
KEY = ["o_orderkey"]
_SOME = "SELECT o_orderkey FROM orders WHERE o_totalprice > 499000"


def priced(t: Tables) -> DataFrame:
    """Orders whose only defect is a word for a price, with reasons; ordered by key."""
    text = landed_orders(t).drop("o_orderpriority").withColumn("o_custkey", F.lit("1"))
    return C.check_rows(text.withColumn("o_orderdate", V.expand_datetime(F.col("o_orderdate"))), PRICED)


@query(
    "policy_stop",
    f"""SELECT o_orderkey, o_orderstatus FROM orders
        WHERE NOT EXISTS ({_SOME}) OR o_orderkey < (SELECT min(o_orderkey) FROM ({_SOME}))""",
)
def policy_stop(t: Tables) -> DataFrame:
    return P.loaded_rows(priced(t), P.ErrorPolicy("stop"), KEY).select("o_orderkey", "o_orderstatus")


@query("policy_skip", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_totalprice > 499000")
def policy_skip(t: Tables) -> DataFrame:
    return P.loaded_rows(priced(t), P.ErrorPolicy("skip_row"), KEY).select("o_orderkey", "o_orderstatus")


_FIFTH = f"(SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM ({_SOME}) ORDER BY o_orderkey LIMIT 5))"


@query(
    "policy_skip_limit",
    f"""SELECT o_orderkey, o_orderstatus FROM orders
        WHERE NOT o_totalprice > 499000 AND ((SELECT count(*) FROM ({_SOME})) < 5 OR o_orderkey < {_FIFTH})""",
)
def policy_skip_limit(t: Tables) -> DataFrame:
    limited = P.ErrorPolicy("skip_row", max_errors=5)
    return P.loaded_rows(priced(t), limited, KEY).select("o_orderkey", "o_orderstatus")


_COUNTS = """SELECT 'tpch' AS "schema", 'orders_{0}' AS "table", count(*) AS expected, {1} AS actual,
    {2} AS skipped, {3} AS errors FROM orders"""
_IS_BAD = "count(*) FILTER (WHERE o_totalprice > 499000)"
_IS_GOOD = "count(*) FILTER (WHERE NOT o_totalprice > 499000)"
_FEW = f"(SELECT count(*) FROM ({_SOME})) < "
_BEFORE_FIRST = f"count(*) FILTER (WHERE {_FEW} 1 OR o_orderkey < (SELECT min(o_orderkey) FROM ({_SOME})))"
_BEFORE_FIFTH = f"count(*) FILTER (WHERE NOT o_totalprice > 499000 AND ({_FEW} 5 OR o_orderkey < {_FIFTH}))"
_IMPORTS = " UNION ALL ".join(
    [
        _COUNTS.format("stop", _BEFORE_FIRST, "0", f"least(1, {_IS_BAD})"),
        _COUNTS.format("skip", _IS_GOOD, _IS_BAD, _IS_BAD),
        _COUNTS.format("limit", _BEFORE_FIFTH, f"least(5, {_IS_BAD})", f"least(5, {_IS_BAD})"),
        _COUNTS.format("log", _IS_GOOD, "0", _IS_BAD),
    ]
)


def all_policies(t: Tables) -> DataFrame:
    kinds = {
        "stop": P.ErrorPolicy("stop"),
        "skip": P.ErrorPolicy("skip_row"),
        "limit": P.ErrorPolicy("skip_row", max_errors=5),
        "log": P.ErrorPolicy("log_only"),
    }
    # Four policies over one table: checked once.
    checked = stage(priced(t), "checked")
    return R.union_all([P.import_counts(checked, p, KEY, "tpch", f"orders_{k}") for k, p in kinds.items()])


@query("import_counts", _IMPORTS)
def import_counts(t: Tables) -> DataFrame:
    return all_policies(t)


@query("policy_log", "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 499000")
def policy_log(t: Tables) -> DataFrame:
    return P.loaded_rows(priced(t), P.ErrorPolicy("log_only"), KEY).select("o_orderkey")


@query(
    "report_totals",
    f"""SELECT count(*) AS tables, sum(expected)::BIGINT AS expected, sum(actual)::BIGINT AS actual,
               sum(skipped)::BIGINT AS skipped, sum(errors)::BIGINT AS errors,
               count(*) FILTER (WHERE errors > 0 OR skipped > 0 OR actual <> expected) AS failed_tables,
               'PARTIAL' AS status
        FROM ({_IMPORTS})""",
)
def report_totals(t: Tables) -> DataFrame:
    return R.report_totals(all_policies(t))


@query(
    "counts_by_table",
    """WITH r AS (
           SELECT 'tpch' AS "schema", 'customer' AS "table", c_acctbal >= 0 AS ok FROM customer
           UNION ALL SELECT 'tpch', 'supplier', s_acctbal >= 0 FROM supplier
           UNION ALL SELECT 'logs', 'events', event_type <> 'error' FROM events),
            per AS (SELECT "schema", "table", count(*) AS expected, count(*) FILTER (WHERE ok) AS actual,
                    count(*) FILTER (WHERE NOT ok) AS skipped, count(*) FILTER (WHERE NOT ok) AS errors
                    FROM r GROUP BY 1, 2)
       SELECT * FROM per
       UNION ALL SELECT NULL, NULL, sum(expected)::BIGINT, sum(actual)::BIGINT, sum(skipped)::BIGINT,
                        sum(errors)::BIGINT FROM per""",
)
def counts_by_table(t: Tables) -> DataFrame:
    def tagged(df, schema, table, ok):
        return df.select(F.lit(schema).alias("schema"), F.lit(table).alias("table"), ok.alias("accepted"))

    rows = R.union_all(
        [
            tagged(t.customer, "tpch", "customer", F.col("c_acctbal") >= 0),
            tagged(t.supplier, "tpch", "supplier", F.col("s_acctbal") >= 0),
            tagged(t.events, "logs", "events", F.col("event_type") != "error"),
        ]
    )
    return R.counts_by_status(rows)


EXPORTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
_EXPORTS = " UNION ALL ".join(
    f"SELECT 'tpch' AS \"schema\", '{n}' AS \"table\", count(*) AS rows, CAST(ceil(count(*) / 5000) AS BIGINT) AS batches FROM {n}"
    for n in EXPORTED
)


def exports(t: Tables) -> DataFrame:
    return R.union_all([R.export_counts(getattr(t, n), "tpch", n) for n in EXPORTED])


@query("export_counts", _EXPORTS)
def export_counts(t: Tables) -> DataFrame:
    return exports(t)


@query("export_totals", f"SELECT count(*) AS tables, sum(rows)::BIGINT AS rows FROM ({_EXPORTS})")
def export_totals(t: Tables) -> DataFrame:
    return R.export_totals(exports(t))


@query(
    "key_statistics",
    """SELECT 'lineitem' AS "table", 'l_orderkey,l_linenumber' AS "key", count(*) AS rows, count(*) AS keyed_rows,
              count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys FROM lineitem
       UNION ALL SELECT 'lineitem', 'l_orderkey', count(*), count(*), count(DISTINCT l_orderkey) FROM lineitem
       UNION ALL SELECT 'orders', 'o_orderkey', count(*), count(*), count(DISTINCT o_orderkey) FROM orders""",
)
def key_statistics(t: Tables) -> DataFrame:
    lines = R.key_statistics(t.lineitem, [["l_orderkey", "l_linenumber"], ["l_orderkey"]], "lineitem")
    return R.union_all([lines, R.key_statistics(t.orders, [["o_orderkey"]], "orders")])


_PROFILE = """SELECT 'customer' AS "table", '{c}' AS "column", '{t}' AS type, count(*) AS rows,
    count(*) FILTER (WHERE {c} IS NULL) AS nulls, {length} AS max_length, {digits} AS max_digits,
    {scale} AS max_scale FROM customer"""
_TEXT = "regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '^-', ''), '[.]0$', '')"


def _profile_sql(c: str, kind: str) -> str:
    text = _TEXT.format(c=c)
    if kind == "string":
        return _PROFILE.format(c=c, t=kind, length=f"max(length({c}))", digits="CAST(NULL AS BIGINT)", scale="CAST(NULL AS BIGINT)")
    return _PROFILE.format(
        c=c,
        t=kind,
        length="CAST(NULL AS BIGINT)",
        digits=f"max(length(split_part({text}, '.', 1)))",
        scale=f"max(length(split_part({text}, '.', 2)))",
    )


@query(
    "column_profile",
    " UNION ALL ".join(
        _profile_sql(c, k)
        for c, k in (
            ("c_custkey", "bigint"),
            ("c_name", "string"),
            ("c_nationkey", "int"),
            ("c_acctbal", "double"),
            ("c_mktsegment", "string"),
        )
    ),
)
def column_profile(t: Tables) -> DataFrame:
    return R.column_profile(t.customer, "customer")


@query(
    "report_json",
    f"""SELECT 'oracle' AS source_dialect, 'postgres' AS target_dialect, 4 AS tables,
               sum(expected)::BIGINT AS total_expected, sum(actual)::BIGINT AS total_actual,
               sum(skipped)::BIGINT AS total_skipped, sum(errors)::BIGINT AS total_errors, 'PARTIAL' AS status
        FROM ({_IMPORTS})""",
)
def report_json(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    write_report(all_policies(t), path, "oracle", "postgres")
    back = t.spark.read.json(path)
    return back.select(
        "source_dialect", "target_dialect", F.size("tables").alias("tables"),
        "total_expected", "total_actual", "total_skipped", "total_errors", "status",
    )


@query(
    "reject_sink",
    f"""SELECT reason, "column", count(*) AS n FROM (
            SELECT 'LENGTH' AS reason, 'o_orderpriority' AS "column" FROM orders WHERE {_LONG}
            UNION ALL SELECT 'NOT_NULL', 'o_custkey' FROM orders WHERE {_MISSING}
            UNION ALL SELECT 'CAST', 'o_totalprice' FROM orders WHERE {_WORD}) GROUP BY ALL""",
)
def reject_sink(t: Tables) -> DataFrame:
    plain = TableSpec("tpch", "orders", ORDERS.columns, primary_key=())
    checked = check_table(landed_orders(t), plain, STEPS)
    path = scratch_path(t.spark, "rejects")
    write_rejects(C.rejects(checked, ["o_orderkey"], plain), path)
    return t.spark.read.parquet(path).groupBy("reason", "column").agg(F.count(F.lit(1)).alias("n"))
