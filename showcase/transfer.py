"""Files, scripts and databases: what is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywright.functions import values as V
from ferrywright.operators.reconcile import remaining_rows
from ferrywright.operators.report import union_all
from ferrywright.plans.convert import convert_folder, convert_table
from ferrywright.plans.load import Transforms
from ferrywright.session import is_local, scratch_path
from ferrywright.sinks.files import write_csv
from ferrywright.sinks.insert_script import insert_statements, write_insert_script
from ferrywright.sinks.tables import append_table, reload_table
from ferrywright.sources import jdbc
from ferrywright.sources import landing as L
from ferrywright.sources.paging import keyset_page
from ferrywright.sources.selection import TableSelection
from ferrywright.sources.split_csv import read_landing_split
from ferrywright.spec import ColumnSpec, TableSpec
from ferrywright.streaming.key_index import indexes
from ferrywright.streaming.landing_stream import ingest_new_files, read_ingested
from showcase.registry import Tables, query

_COUNTS = " UNION ALL ".join(
    f"SELECT '{s}' AS \"schema\", '{n}' AS \"table\", count(*) AS rows FROM {q}"
    for s, n, q in (
        ("tpch", "region", "region"),
        ("tpch", "nation", "nation"),
        ("tpch", "customer", "customer"),
        ("tpch", "documents", "documents"),
        ("web", "logs.events", "events"),
    )
)


def land(t: Tables) -> str:
    """A landing folder with five tables, one of them with a dot in its name."""
    folder = scratch_path(t.spark, "landing")
    for name in ("region", "nation", "customer", "documents"):
        write_csv(getattr(t, name), f"{folder}/tpch.{name}.csv")
    write_csv(t.events, f"{folder}/web.logs.events.csv")
    return folder


@query("landing_counts", _COUNTS)
def landing_counts(t: Tables) -> DataFrame:
    return L.landing_counts(t.spark, land(t))


@query(
    "table_selection",
    f"""SELECT * FROM ({_COUNTS}) WHERE "schema" = 'tpch' AND "table" NOT IN ('customer', 'region')""",
)
def table_selection(t: Tables) -> DataFrame:
    chosen = TableSelection(
        include=("tpch.*", "web.*"),
        exclude_glob=("cust*",),
        exclude_regex=(r"^reg\w+$",),
        exclude_schemas=("WEB",),
        exclude_tables=("TPCH.PART",),
    )
    counts = L.landing_counts(t.spark, land(t))
    return counts.filter(chosen.predicate(F.col("schema"), F.col("table")))


@query(
    "csv_roundtrip",
    r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang,
               CASE WHEN lang = 'fr' THEN '' ELSE source END AS source FROM documents""",
)
def csv_roundtrip(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id",
        "text",
        V.null_if(F.col("lang"), ["en"]).alias("lang"),
        F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("source"),
    )
    path = f"{scratch_path(t.spark, 'csv')}/tpch.documents.csv"
    write_csv(rows, path)
    return L.split_malformed(L.read_landing(t.spark, path, rows.columns))[0]


@query(
    "csv_split_multiline",
    r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang,
               CASE WHEN lang = 'fr' THEN '' ELSE source END AS source FROM documents""",
)
def csv_split_multiline(t: Tables) -> DataFrame:
    """The rows of `csv_roundtrip` from a few large files, each of which several tasks read."""
    rows = t.documents.select(
        "doc_id",
        "text",
        V.null_if(F.col("lang"), ["en"]).alias("lang"),
        F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("source"),
    )
    path = f"{scratch_path(t.spark, 'csv')}/tpch.documents.csv"
    # A file for every two splits of the table: large enough to be cut when it is read, and bounded for the task that writes it.
    write_csv(rows.coalesce(max(1, rows.rdd.getNumPartitions() // 2)), path)
    return L.split_malformed(read_landing_split(t.spark, path, rows.columns))[0]


@query(
    "csv_layout_roundtrip",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y%m%d%H%M%S') AS o_orderdate,
              regexp_replace(CAST(o_totalprice AS VARCHAR), '[.]0$', '') AS o_totalprice
       FROM orders""",
)
def csv_layout_roundtrip(t: Tables) -> DataFrame:
    layout = L.CsvLayout(sep="|", quote="'", header=False, null_marker="<null>", encoding="LATIN1", multi_line=False)
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    path = f"{scratch_path(t.spark, 'csv')}/tpch.orders.csv"
    write_csv(rows, path, layout, order=["o_orderkey"])
    return L.split_malformed(L.read_landing(t.spark, path, rows.columns, layout))[0]


@query(
    "malformed_rows",
    """SELECT 'CSV_SHAPE' AS reason,
              CASE WHEN o_orderstatus = 'P' THEN o_orderkey || ',' || o_custkey
                   ELSE o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',surplus' END AS value
       FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'""",
)
def malformed_rows(t: Tables) -> DataFrame:
    return L.split_malformed(ragged(t))[1]


@query(
    "well_shaped_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderstatus AS c
       FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'""",
)
def well_shaped_rows(t: Tables) -> DataFrame:
    return L.split_malformed(ragged(t))[0]


def ragged(t: Tables) -> DataFrame:
    """Lines of three fields, some with two, some with four."""
    path = f"{scratch_path(t.spark, 'ragged')}/tpch.orders.csv"
    short = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    line = (
        F.when(F.col("o_orderstatus") == "P", short)
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws(",", short, "o_orderstatus", F.lit("surplus")))
        .otherwise(F.concat_ws(",", short, "o_orderstatus"))
    )
    t.orders.select(line.alias("value")).write.text(path)
    return L.read_landing(t.spark, path, ["a", "b", "c"], L.CsvLayout(header=False))


# --- scripts -------------------------------------------------------------------------

_TUPLE = (
    "'(' || o_orderkey || ', ' || o_custkey || ', ''' || o_orderpriority || ''', ''' "
    "|| strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''')'"
)
_BATCHES = f"""SELECT (rn - 1) // 100 AS batch, count(*) AS rows, string_agg(line, ',\n  ' ORDER BY rn) AS body
    FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, {_TUPLE} AS line FROM orders) GROUP BY 1"""
SCRIPTED = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"]


@query(
    "insert_script",
    f"""SELECT batch, rows, 'INSERT INTO "tpch"."orders" ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
VALUES
  ' || body || ';' AS statement FROM ({_BATCHES})""",
)
def insert_script(t: Tables) -> DataFrame:
    return insert_statements(t.orders.select(*SCRIPTED), "tpch", "orders", ["o_orderkey"], "postgres", 100)


@query(
    "insert_script_mysql",
    f"""SELECT CASE WHEN batch = 0 THEN 'TRUNCATE TABLE `tpch`.`orders`;\n\n' ELSE '' END ||
        'INSERT INTO `tpch`.`orders` (`o_orderkey`, `o_custkey`, `o_orderpriority`, `o_orderdate`)
VALUES
  ' || body || ';' AS statement FROM ({_BATCHES})""",
)
def insert_script_mysql(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "script")
    rows = t.orders.select(*SCRIPTED)
    path = write_insert_script(rows, folder, "tpch", "orders", ["o_orderkey"], "mysql", 100, truncate=True)
    # Every record of the script ends with a blank line.
    text = t.spark.read.option("lineSep", ";\n\n").text(path)
    whole = text.filter(F.col("value") != "").select(F.concat("value", F.lit(";")).alias("statement"))
    opening = "TRUNCATE TABLE `tpch`.`orders`;"
    joined = whole.filter(F.col("statement") != opening)
    first = F.col("statement").contains("\n  (0, ")
    return joined.select(
        F.when(first, F.concat(F.lit(opening + "\n\n"), "statement")).otherwise(F.col("statement")).alias("statement")
    )


@query(
    "convert_csv",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def convert_csv(t: Tables) -> DataFrame:
    source, target = scratch_path(t.spark, "offline"), scratch_path(t.spark, "converted")
    write_csv(t.documents, f"{source}/tpch.documents.csv")
    layout = L.CsvLayout()
    path = convert_table(t.spark, source, target, "TPCH", "Documents", "csv", layout)
    return L.split_malformed(L.read_landing(t.spark, path, t.documents.columns, layout))[0]


@query(
    "convert_folder",
    """SELECT 'tpch.nation' AS "table", CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_name <> 'NATION_3' THEN n_name END AS name FROM nation
       UNION ALL SELECT 'tpch.region', CAST(r_regionkey AS VARCHAR), r_name FROM region""",
)
def convert_folder_query(t: Tables) -> DataFrame:
    """Two of five landed tables, with a value that stands for NULL."""
    source, target = land(t), scratch_path(t.spark, "converted")
    chosen = TableSelection(include=("tpch.*",), exclude_tables=("TPCH.customer",), exclude_regex=("^doc",))
    done = convert_folder(t.spark, source, target, chosen, steps=Transforms(null_if=("NATION_3",)))
    parts = []
    for name, path in done.items():
        columns = L.read_header(t.spark, path)
        rows = L.split_malformed(L.read_landing(t.spark, path, columns))[0]
        key, label = [F.col(c) for c in columns if c.endswith(("key", "name"))][:2]
        parts.append(rows.select(F.lit(name).alias("table"), key.alias("key"), label.alias("name")))
    return union_all(parts)


@query("convert_sql", "SELECT count(*) // 100 + CAST(count(*) % 100 > 0 AS INT) AS inserts, count(*) AS rows FROM orders")
def convert_sql(t: Tables) -> DataFrame:
    source, target = scratch_path(t.spark, "offline"), scratch_path(t.spark, "converted")
    write_csv(t.orders.select(*SCRIPTED), f"{source}/tpch.orders.csv")
    path = convert_table(t.spark, source, target, "tpch", "orders", "sql", dialect="oracle")
    lines = t.spark.read.text(path)
    return lines.agg(
        F.count_if(F.col("value").startswith("INSERT INTO")).alias("inserts"),
        F.count_if(F.col("value").startswith("  (")).alias("rows"),
    )


# --- databases -------------------------------------------------------------------------

JDBC_URL, JDBC_DRIVER = "spark.ferrywright.jdbc.url", "spark.ferrywright.jdbc.driver"


def database(spark: SparkSession) -> jdbc.Database:
    """The database named in the session settings, or in local runs one inside this process."""
    url = spark.conf.get(JDBC_URL, None)
    if url:
        return jdbc.Database(url, spark.conf.get(JDBC_DRIVER))
    if not is_local(spark):
        raise RuntimeError(f"set {JDBC_URL} and {JDBC_DRIVER}: an in-process database is not shared by executors")
    name = f"memory:ferrywright{uuid.uuid4().hex}"
    return jdbc.Database(f"jdbc:derby:{name};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver")


CUSTOMER = TableSpec(
    "tpch",
    "customer",
    (
        ColumnSpec("c_custkey", "BIGINT", nullable=False),
        ColumnSpec("c_name", "VARCHAR", length=25),
        ColumnSpec("c_nationkey", "INT"),
        ColumnSpec("c_acctbal", "NUMERIC", precision=12, scale=2),
        ColumnSpec("c_mktsegment", "VARCHAR", length=10),
    ),
    dialect="postgres",
    primary_key=("c_custkey",),
)


def priced_customer(t: Tables) -> DataFrame:
    return t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))


def filled(t: Tables, rows: DataFrame | None = None) -> tuple[jdbc.Database, str]:
    """A database with the customer table, and the table's name."""
    db, table = database(t.spark), f"customer_{uuid.uuid4().hex[:8]}"
    append_table(priced_customer(t) if rows is None else rows, db, table, spec=CUSTOMER)
    return db, table


def plain(df: DataFrame) -> DataFrame:
    return df.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("jdbc_roundtrip", "SELECT * FROM customer")
def jdbc_roundtrip(t: Tables) -> DataFrame:
    db, table = filled(t)
    return plain(jdbc.scan(t.spark, db, table, [c.name for c in CUSTOMER.ordered()]))


@query("jdbc_parallel", "SELECT * FROM customer")
def jdbc_parallel(t: Tables) -> DataFrame:
    db, table = filled(t)
    return plain(jdbc.scan_by_range(t.spark, db, table, "c_custkey", 4))


@query("jdbc_balanced", "SELECT c_custkey * c_custkey AS c_custkey, c_name FROM customer")
def jdbc_balanced(t: Tables) -> DataFrame:
    # Squares: most keys crowd at the low end of their range.
    db, table = filled(t, priced_customer(t).withColumn("c_custkey", F.col("c_custkey") * F.col("c_custkey")))
    ranges = jdbc.balanced_ranges(t.spark, db, table, "c_custkey", 4)
    return jdbc.scan_by_predicates(t.spark, db, table, ranges, ["c_custkey", "c_name"])


@query("jdbc_keyless", "SELECT c_name, c_mktsegment, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer")
def jdbc_keyless(t: Tables) -> DataFrame:
    nation = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))
    db, table = filled(t, priced_customer(t).withColumn("c_nationkey", nation))
    buckets = jdbc.bucket_predicates(db.quoted("c_nationkey"), 5)
    return jdbc.scan_by_predicates(t.spark, db, table, buckets, ["c_name", "c_mktsegment", "c_nationkey"])


@query("jdbc_text_ranges", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def jdbc_text_ranges(t: Tables) -> DataFrame:
    db, table = filled(t)
    ranges = jdbc.text_ranges(db, "c_mktsegment", ["BUILDING", "HOUSEHOLD", "MACHINERY"])
    return jdbc.scan_by_predicates(t.spark, db, table, ranges).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("jdbc_truncate_reload", "SELECT * FROM customer")
def jdbc_truncate_reload(t: Tables) -> DataFrame:
    stale = priced_customer(t).withColumn("c_name", F.lit("stale"))
    db, table = filled(t, stale)
    reload_table(priced_customer(t), db, table, spec=CUSTOMER)
    return plain(jdbc.scan(t.spark, db, table))


@query(
    "jdbc_typed_create",
    """SELECT 'c_acctbal' AS name, 'decimal(12,2)' AS type UNION ALL SELECT 'c_custkey', 'bigint'
       UNION ALL SELECT 'c_mktsegment', 'varchar(10)' UNION ALL SELECT 'c_name', 'varchar(25)'
       UNION ALL SELECT 'c_nationkey', 'int'""",
)
def jdbc_typed_create(t: Tables) -> DataFrame:
    db, table = filled(t)
    created = jdbc.scan(t.spark, db, table)
    types = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())).alias("type"),
        )
        for f in created.schema.fields
    ]
    # One row per column, only if the rows arrived.
    return created.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(F.inline(F.array(*types)))


@query(
    "jdbc_keyset_page",
    "SELECT c_nationkey, c_custkey FROM customer WHERE (c_nationkey, c_custkey) > (7, 120) ORDER BY c_nationkey, c_custkey LIMIT 40",
)
def jdbc_keyset_page(t: Tables) -> DataFrame:
    db, table = filled(t)
    page = keyset_page(jdbc.scan(t.spark, db, table), ["c_nationkey", "c_custkey"], 40, {"c_nationkey": 7, "c_custkey": 120})
    return page.select("c_nationkey", "c_custkey")


@query("jdbc_resume", "SELECT * FROM customer")
def jdbc_resume(t: Tables) -> DataFrame:
    rows = priced_customer(t)
    db, table = filled(t, rows.filter(F.col("c_acctbal") < 5000))
    for _ in range(2):
        append_table(remaining_rows(rows, jdbc.scan(t.spark, db, table, ["c_custkey"]), ["c_custkey"]), db, table)
    return plain(jdbc.scan(t.spark, db, table))


# --- incremental ingest --------------------------------------------------------------

ORDERS = TableSpec(
    "tpch",
    "orders",
    (
        ColumnSpec("o_orderkey", "BIGINT", nullable=False),
        ColumnSpec("o_custkey", "BIGINT"),
        ColumnSpec("o_orderstatus", "VARCHAR", length=1),
        ColumnSpec("o_orderdate", "TIMESTAMP"),
        ColumnSpec("o_orderpriority", "VARCHAR", length=14),
    ),
    dialect="postgres",
    primary_key=("o_orderkey",),
)


def ingest_drops(t: Tables, drops: list[DataFrame], indexed: bool = False) -> tuple[str, str]:
    """A run after each drop and one run with nothing new; target and rejects."""
    root = scratch_path(t.spark, "ingest")
    source, target, rejects = f"{root}/tpch.orders.csv", f"{root}/orders", f"{root}/rejects"
    for drop in [*drops, None]:
        if drop is not None:
            write_csv(drop, source, mode="append")
        steps = Transforms(datetime_format=V.COMPACT_DATETIME)
        index = indexes(f"{root}/keys", ORDERS, 16) if indexed else ()
        ingest_new_files(t.spark, source, ORDERS, target, rejects, f"{root}/checkpoint", steps, index=index)
    return target, rejects


def ingest_two_drops(t: Tables) -> tuple[str, str]:
    rows = t.orders.select(*[c.name for c in ORDERS.ordered()])
    final = F.col("o_orderstatus") == "F"
    return ingest_drops(t, [rows.filter(final), rows.filter(~final)])


@query(
    "incremental_landing",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders
       WHERE length(o_orderpriority) <= 14""",
)
def incremental_landing(t: Tables) -> DataFrame:
    return read_ingested(t.spark, ingest_two_drops(t)[0])


@query(
    "incremental_rejects",
    """SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'LENGTH' AS reason, o_orderpriority AS value FROM orders
       WHERE length(o_orderpriority) > 14""",
)
def incremental_rejects(t: Tables) -> DataFrame:
    return read_ingested(t.spark, ingest_two_drops(t)[1]).select("row_key", "reason", "value")


@query(
    "incremental_duplicates",
    """WITH o AS (SELECT o_orderkey, length(o_orderpriority) > 14 AS bad, o_orderstatus = 'F' AS old,
         o_orderstatus = 'F' AND o_custkey % 3 = 0 AS twice FROM orders),
       n AS (SELECT *, CAST(old AS BIGINT) + CAST(twice AS BIGINT) + CAST(bad AS BIGINT) AS n FROM o)
       SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN bad THEN 'LENGTH' ELSE 'DUP_PK' END AS reason, n
       FROM n WHERE n > 0""",
)
def incremental_duplicates(t: Tables) -> DataFrame:
    """One key twice in a drop, and again in the next one."""
    rows = t.orders.select(*[c.name for c in ORDERS.ordered()])
    final = rows.filter("o_orderstatus = 'F'")
    _, rejects = ingest_drops(t, [final.union(final.filter("o_custkey % 3 = 0")), rows])
    return read_ingested(t.spark, rejects).groupBy("row_key", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "incremental_indexed",
    """WITH o AS (SELECT o_orderkey, length(o_orderpriority) > 14 AS bad, o_orderstatus = 'F' AS old,
         o_orderstatus = 'F' AND o_custkey % 3 = 0 AS twice FROM orders),
       n AS (SELECT *, CAST(old AS BIGINT) + CAST(twice AS BIGINT) + CAST(bad AS BIGINT) AS n FROM o)
       SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN bad THEN 'LENGTH' ELSE 'DUP_PK' END AS reason, n
       FROM n WHERE n > 0""",
)
def incremental_indexed(t: Tables) -> DataFrame:
    """The same as `incremental_duplicates`, from an index of keys that the batches keep."""
    rows = t.orders.select(*[c.name for c in ORDERS.ordered()])
    final = rows.filter("o_orderstatus = 'F'")
    _, rejects = ingest_drops(t, [final.union(final.filter("o_custkey % 3 = 0")), rows], indexed=True)
    return read_ingested(t.spark, rejects).groupBy("row_key", "reason").agg(F.count(F.lit(1)).alias("n"))
