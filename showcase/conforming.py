"""Types: from one database's columns, to another's values, and by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.dialects import NameRule, ParamRule, TypeRules
from ferrywright.operators.conform import conform, for_target, target_overflow
from ferrywright.spec import ColumnSpec, LogicalType, TableSpec
from showcase.registry import Tables, query


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def spec(name: str, dialect: str, *columns: ColumnSpec) -> TableSpec:
    return TableSpec("tpch", name, columns, dialect=dialect)


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Decimals and floats as doubles, so that both engines print them alike."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


CUSTOMER_ORACLE = spec(
    "customer",
    "oracle",
    ColumnSpec("c_custkey", "NUMBER", precision=18, nullable=False),
    ColumnSpec("c_name", "VARCHAR2", length=25),
    ColumnSpec("c_nationkey", "NUMBER", precision=4),
    ColumnSpec("c_acctbal", "NUMBER", precision=6, scale=2),
    ColumnSpec("c_mktsegment", "CHAR", length=10),
)


@query(
    "conform_oracle",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS SMALLINT) AS c_nationkey,
              CAST(CAST(c_acctbal AS DECIMAL(6,2)) AS DOUBLE) AS c_acctbal, c_mktsegment
       FROM customer""",
)
def conform_oracle(t: Tables) -> DataFrame:
    return doubles(conform(as_strings(t.customer), CUSTOMER_ORACLE), "c_acctbal")


ORDERS_POSTGRES = spec(
    "orders",
    "opengaussdb",
    ColumnSpec("o_orderkey", "SERIAL8"),
    ColumnSpec("o_custkey", "INT8"),
    ColumnSpec("o_orderstatus", "BOOLEAN"),
    ColumnSpec("o_totalprice", "NUMERIC", precision=8, scale=1),
    ColumnSpec("o_orderdate", "TIMESTAMP"),
    ColumnSpec("o_orderpriority", "CHARACTER VARYING", length=20),
)


@query(
    "conform_postgres",
    """SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN false END AS o_orderstatus,
              CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(8,1)) AS DOUBLE) AS o_totalprice,
              CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority
       FROM orders""",
)
def conform_postgres(t: Tables) -> DataFrame:
    # Of the order states only F also reads as a boolean.
    return doubles(conform(as_strings(t.orders), ORDERS_POSTGRES), "o_totalprice")


LINEITEM_MYSQL = spec(
    "lineitem",
    "goldendb",
    ColumnSpec("l_orderkey", "BIGINT"),
    ColumnSpec("l_linenumber", "TINYINT"),
    ColumnSpec("l_quantity", "DOUBLE"),
    ColumnSpec("l_extendedprice", "DECIMAL", precision=10, scale=2),
    ColumnSpec("l_discount", "FLOAT"),
    ColumnSpec("l_returnflag", "ENUM", enum_values=("A", "N", "R")),
    ColumnSpec("l_shipdate", "DATETIME"),
)


@query(
    "conform_mysql",
    """SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, l_quantity,
              CAST(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(10,2)) AS DOUBLE) AS l_extendedprice,
              CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS l_discount, l_returnflag,
              CAST(l_shipdate AS TIMESTAMP) AS l_shipdate
       FROM lineitem""",
)
def conform_mysql(t: Tables) -> DataFrame:
    rows = as_strings(t.lineitem.select(*[c.name for c in LINEITEM_MYSQL.columns]))
    return doubles(conform(rows, LINEITEM_MYSQL), "l_extendedprice", "l_discount")


SUPPLIER_SQLITE = spec(
    "supplier",
    "sqlite3",
    ColumnSpec("s_suppkey", "INTEGER"),
    ColumnSpec("s_name", "TEXT"),
    ColumnSpec("s_nationkey", "INTEGER"),
    ColumnSpec("s_acctbal", "REAL"),
)


@query(
    "conform_sqlite",
    """SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey,
              CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS s_acctbal FROM supplier""",
)
def conform_sqlite(t: Tables) -> DataFrame:
    return doubles(conform(as_strings(t.supplier), SUPPLIER_SQLITE), "s_acctbal")


EVENTS_DUCKDB = spec(
    "events",
    "duckdb",
    ColumnSpec("event_id", "INT64"),
    ColumnSpec("ts", "TIMESTAMP_NS"),
    ColumnSpec("user_id", "HUGEINT"),
    ColumnSpec("event_type", "STRING"),
    ColumnSpec("value", "FLOAT8"),
    ColumnSpec("props", "JSON"),
)


@query(
    "conform_duckdb",
    "SELECT event_id, ts, CAST(user_id AS DOUBLE) AS user_id, event_type, value, props FROM events",
)
def conform_duckdb(t: Tables) -> DataFrame:
    return doubles(conform(as_strings(t.events), EVENTS_DUCKDB), "user_id")


@query(
    "conform_misfits",
    """SELECT event_id, CAST(NULL AS BIGINT) AS event_type, CAST(NULL AS TIMESTAMP) AS props,
              TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS user_id
       FROM events""",
)
def conform_misfits(t: Tables) -> DataFrame:
    loose = t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        "props",
        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"),
    )
    declared = spec(
        "events",
        "postgres",
        ColumnSpec("event_id", "BIGINT"),
        ColumnSpec("event_type", "BIGINT"),
        ColumnSpec("props", "TIMESTAMP"),
        ColumnSpec("user_id", "INT4"),
    )
    return conform(loose, declared)


# --- values for a target ----------------------------------------------------------


def mixed_rows(t: Tables) -> DataFrame:
    """Orders with a boolean, a text with empties, a number and zoned time."""
    return t.orders.select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("is_final"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("note"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.col("o_totalprice").cast("decimal(38,10)").alias("whole"),
        F.col("o_orderdate").alias("ordered"),
        F.col("o_orderdate").cast("timestamp").alias("zoned"),
    )


MIXED = spec(
    "orders",
    "postgres",
    ColumnSpec("o_orderkey", "BIGINT"),
    ColumnSpec("is_final", "BOOLEAN"),
    ColumnSpec("note", "VARCHAR", length=20),
    ColumnSpec("price", "NUMERIC", precision=12, scale=2),
    ColumnSpec("whole", "NUMERIC"),
    ColumnSpec("ordered", "TIMESTAMP"),
    ColumnSpec("zoned", "TIMESTAMPTZ"),
)


@query(
    "target_mysql",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS TINYINT) AS is_final,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS note,
              o_totalprice AS price, o_orderdate AS ordered, o_orderdate AS zoned
       FROM orders""",
)
def target_mysql(t: Tables) -> DataFrame:
    return doubles(for_target(mixed_rows(t), MIXED, "oceanbase").drop("whole"), "price")


@query(
    "target_oracle",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_final,
              CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS note,
              o_totalprice AS price, o_orderdate AS ordered
       FROM orders""",
)
def target_oracle(t: Tables) -> DataFrame:
    return doubles(for_target(mixed_rows(t), MIXED, "oracle").drop("whole", "zoned"), "is_final", "price")


@query(
    "target_sqlite",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS is_final,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS note,
              o_totalprice AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
              strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered,
              strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS zoned
       FROM orders""",
)
def target_sqlite(t: Tables) -> DataFrame:
    return for_target(mixed_rows(t), MIXED, "sqlite3")


@query(
    "target_duckdb",
    """SELECT o_orderkey, o_orderstatus = 'F' AS is_final,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS note,
              o_totalprice AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
              o_orderdate AS ordered, o_orderdate AS zoned
       FROM orders""",
)
def target_duckdb(t: Tables) -> DataFrame:
    return doubles(for_target(mixed_rows(t), MIXED, "duckdb"), "price")


@query(
    "target_postgres",
    """SELECT o_orderkey, o_orderstatus = 'F' AS is_final,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS note,
              o_totalprice AS price, o_orderdate AS ordered
       FROM orders""",
)
def target_postgres(t: Tables) -> DataFrame:
    return doubles(for_target(mixed_rows(t), MIXED, "panweidb").drop("whole", "zoned"), "price")


@query(
    "target_overflow",
    """SELECT p_partkey, CAST(power(CAST(p_size AS DOUBLE), 14) AS DECIMAL(38,0)) > 9223372036854775807 AS overflows
       FROM part""",
)
def target_overflow_rows(t: Tables) -> DataFrame:
    # p_size to the 14th: beyond 64 bits for the larger parts.
    big = F.pow(F.col("p_size").cast("double"), 14).cast("decimal(38,0)")
    rows = t.part.select("p_partkey", big.alias("big"))
    return rows.select(
        "p_partkey", target_overflow(F.col("big"), LogicalType("NUMERIC", precision=38), "duckdb").alias("overflows")
    )


# --- rules --------------------------------------------------------------------------

ORACLE_TO_POSTGRES = TypeRules(
    target_dialect="postgres",
    exact={"VARCHAR2": "VARCHAR(%l)", "CHAR": "CHAR(%l)", "NUMBER": "NUMERIC", "DATE": "DATE", "CLOB": "TEXT"},
    parameterized={
        "NUMBER": [
            ParamRule("SMALLINT", scale=0, max_precision=4),
            ParamRule("INTEGER", scale=0, max_precision=9),
            ParamRule("BIGINT", scale=0, max_precision=18),
            ParamRule("NUMERIC(%p,%s)", scale_gt=0),
            ParamRule("NUMERIC"),
        ]
    },
    by_name=[
        NameRule(r"(?i)flag$", "BOOLEAN", type_name="CHAR", length=1),
        NameRule(r"(?i)date$", "TIMESTAMP", type_name="DATE"),
    ],
)

LINEITEM_ORACLE = spec(
    "lineitem",
    "oracle",
    ColumnSpec("l_orderkey", "NUMBER", precision=18),
    ColumnSpec("l_linenumber", "NUMBER", precision=4),
    ColumnSpec("l_extendedprice", "NUMBER", precision=12, scale=1),
    ColumnSpec("l_returnflag", "CHAR", length=1),
    ColumnSpec("l_linestatus", "VARCHAR2", length=1),
    ColumnSpec("l_shipdate", "DATE"),
)


@query(
    "type_rules",
    """SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber,
              CAST(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(12,1)) AS DOUBLE) AS l_extendedprice,
              CASE l_returnflag WHEN 'N' THEN false END AS l_returnflag, l_linestatus,
              CAST(l_shipdate AS TIMESTAMP) AS l_shipdate
       FROM lineitem""",
)
def type_rules(t: Tables) -> DataFrame:
    # Of the return flags only N also reads as a boolean.
    rows = as_strings(t.lineitem.select(*[c.name for c in LINEITEM_ORACLE.columns]))
    return doubles(conform(rows, ORACLE_TO_POSTGRES.apply(LINEITEM_ORACLE)), "l_extendedprice")


@query(
    "type_override",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
              CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""",
)
def type_override(t: Tables) -> DataFrame:
    numbers_as_text = TypeRules("postgres", exact={"VARCHAR2": "VARCHAR(%l)"}, overrides={"NUMBER": "TEXT"})
    return conform(as_strings(t.customer), numbers_as_text.apply(CUSTOMER_ORACLE))
