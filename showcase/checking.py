"""Row integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.operators import checks as C
from ferrywright.operators import report as R
from ferrywright.operators.reconcile import rows_in
from ferrywright.spec import ColumnSpec, ForeignKey, LogicalType, TableSpec
from showcase.registry import Tables, query


@query(
    "not_null_violations",
    """SELECT o_orderkey, 'NOT_NULL' AS reason, 'o_orderpriority' AS "column" FROM orders
       WHERE o_orderpriority = '4-NOT SPECIFIED'""",
)
def not_null_violations(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))
    found = rows.filter(C.not_null_violation(F.col("priority")))
    return found.select("o_orderkey", F.lit("NOT_NULL").alias("reason"), F.lit("o_orderpriority").alias("column"))


@query(
    "cast_failures",
    "SELECT p_partkey, 'n/a' AS value FROM part WHERE p_type = 'PROMO'",
)
def cast_failures(t: Tables) -> DataFrame:
    size = F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.col("p_size").cast("string"))
    rows = t.part.select("p_partkey", size.alias("value"))
    return rows.filter(C.cast_failure(F.col("value"), LogicalType("INT")))


@query(
    "length_overflow",
    """SELECT doc_id, length(text) AS chars, length(text) > 1000 AS too_many_chars,
              octet_length(encode(text)) > 1000 AS too_many_bytes FROM documents""",
)
def length_overflow(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        F.char_length(c).cast("long").alias("chars"),
        C.length_overflow(c, 1000).alias("too_many_chars"),
        C.length_overflow(c, 1000, in_bytes=True).alias("too_many_bytes"),
    )


@query(
    "precision_overflow",
    "SELECT c_custkey, c_acctbal FROM customer WHERE TRY_CAST(c_acctbal AS DECIMAL(5,2)) IS NULL",
)
def precision_overflow(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rows.filter(C.precision_overflow(F.col("c_acctbal").cast("string"), 5, 2))


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(t: Tables) -> DataFrame:
    return C.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
_LINE_RANK = f"row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)})"


@query(
    "first_row_wins",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, {_LINE_RANK} AS rn FROM lineitem) WHERE rn = 1""",
)
def first_row_wins(t: Tables) -> DataFrame:
    return C.first_rows(t.lineitem, LINE_KEY, LINE_ORDER)


@query(
    "duplicate_rejects",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'DUP_PK' AS reason,
               l_orderkey || '|' || l_linenumber AS value
        FROM (SELECT *, {_LINE_RANK} AS rn FROM lineitem) WHERE rn > 1""",
)
def duplicate_rejects(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn(C.REASONS, C.no_reasons())
    marked = C.mark_duplicates(rows, LINE_KEY, LINE_ORDER).filter(F.size(C.REASONS) > 0)
    return marked.select(
        *LINE_KEY, "l_partkey", "l_suppkey", "l_shipdate",
        F.col(C.REASONS)[0]["reason"].alias("reason"), F.col(C.REASONS)[0]["value"].alias("value"),
    )


@query(
    "unique_index_dups",
    """SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events
       WHERE event_type <> 'error' GROUP BY ALL HAVING count(*) > 1""",
)
def unique_index_dups(t: Tables) -> DataFrame:
    rows = t.events.select(
        "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.col("ts").cast("date").alias("day")
    )
    return C.unique_index_duplicates(rows, ["user_id", "event_type", "day"])


EVENT_SUPPLIER = ForeignKey(("user_id",), "supplier", ("s_suppkey",), "SET NULL")


@query(
    "fk_orphans",
    """SELECT user_id, count(*) AS n FROM events
       WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) GROUP BY user_id""",
)
def fk_orphans(t: Tables) -> DataFrame:
    return C.orphan_keys(t.events, t.supplier, EVENT_SUPPLIER)


@query(
    "fk_orphan_rows",
    """SELECT doc_id, 'FK_ORPHAN' AS reason, 'doc_id' AS "column", CAST(doc_id AS VARCHAR) AS value
       FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def fk_orphan_rows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").withColumn(C.REASONS, C.no_reasons())
    fk = ForeignKey(("doc_id",), "labels", ("doc_id",))
    return C.mark_orphans(rows, t.labels, fk).select("doc_id", F.inline(C.REASONS))


@query(
    "fk_composite",
    """SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey, o_custkey FROM orders) p
                         WHERE p.o_orderkey = l_orderkey AND p.o_custkey = l_suppkey)
       GROUP BY ALL""",
)
def fk_composite(t: Tables) -> DataFrame:
    fk = ForeignKey(("l_orderkey", "l_suppkey"), "orders", ("o_orderkey", "o_custkey"))
    return C.orphan_keys(t.lineitem, t.orders, fk)


@query(
    "fk_set_null",
    """SELECT event_id, event_type, CASE WHEN s_suppkey IS NULL THEN NULL ELSE user_id END AS user_id
       FROM events LEFT JOIN supplier ON s_suppkey = user_id""",
)
def fk_set_null(t: Tables) -> DataFrame:
    return C.apply_delete_rule(t.events.select("event_id", "event_type", "user_id"), t.supplier, EVENT_SUPPLIER)


@query(
    "fk_cascade",
    """SELECT event_id, user_id FROM events WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id)""",
)
def fk_cascade(t: Tables) -> DataFrame:
    rule = ForeignKey(("user_id",), "supplier", ("s_suppkey",), "CASCADE")
    return C.apply_delete_rule(t.events.select("event_id", "user_id"), t.supplier, rule)


@query(
    "semi_join",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def semi_join(t: Tables) -> DataFrame:
    toxic = t.labels.filter(F.col("toxic") == 1)
    return rows_in(t.documents.select("doc_id", "lang", "source"), toxic, ["doc_id"])


@query(
    "enum_domain",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
)
def enum_domain(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return rows.filter(C.outside_domain(F.col("o_orderstatus"), ["F", "O"]))


# --- all checks of one declared table -------------------------------------------------

PART = TableSpec(
    "tpch",
    "part",
    (
        ColumnSpec("p_partkey", "NUMBER", precision=18, nullable=False),
        ColumnSpec("p_name", "VARCHAR2", length=10),
        ColumnSpec("p_brand", "VARCHAR2", length=20, nullable=False),
        ColumnSpec("p_type", "VARCHAR2", length=12, enum_values=("ECONOMY", "MEDIUM", "STANDARD", "SMALL", "LARGE")),
        ColumnSpec("p_size", "NUMBER", precision=4),
        ColumnSpec("p_retailprice", "NUMBER", precision=5, scale=2),
        ColumnSpec("p_hash", "RAW", length=20),
    ),
    primary_key=("p_partkey",),
)


def degraded_part(t: Tables) -> DataFrame:
    """Part as landing text with NULLs, words for numbers, long numbers and broken hex."""
    hexed = F.lower(F.hex(F.encode("p_name", "UTF-8")))
    brand, kind = F.col("p_brand"), F.col("p_type")
    size = F.col("p_size").cast("string")
    return t.part.select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        "p_name",
        F.when(brand != "Brand#13", brand).alias("p_brand"),
        "p_type",
        F.when(brand == "Brand#5", "none").when(kind == "LARGE", F.concat(size, F.lit("000"))).otherwise(size).alias("p_size"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("p_retailprice"),
        F.when(kind == "SMALL", F.concat(hexed, F.lit("f"))).otherwise(hexed).alias("p_hash"),
    )


_PART_REASONS = """
    SELECT p_partkey, 'LENGTH' AS reason, 'p_name' AS "column", p_name AS value FROM part WHERE length(p_name) > 10
    UNION ALL SELECT p_partkey, 'NOT_NULL', 'p_brand', NULL FROM part WHERE p_brand = 'Brand#13'
    UNION ALL SELECT p_partkey, 'ENUM', 'p_type', p_type FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT p_partkey, 'CAST', 'p_size', 'none' FROM part WHERE p_brand = 'Brand#5'
    UNION ALL SELECT p_partkey, 'PRECISION', 'p_size', p_size || '000'
              FROM part WHERE p_brand <> 'Brand#5' AND p_type = 'LARGE' AND p_size >= 10
    UNION ALL SELECT p_partkey, 'PRECISION', 'p_retailprice', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
              FROM part WHERE p_retailprice >= 999.995
    UNION ALL SELECT p_partkey, 'BAD_HEX', 'p_hash', lower(hex(encode(p_name))) || 'f' FROM part WHERE p_type = 'SMALL'
"""


@query("row_reasons", _PART_REASONS)
def row_reasons(t: Tables) -> DataFrame:
    checked = C.check_rows(degraded_part(t), PART)
    return checked.filter(F.size(C.REASONS) > 0).select("p_partkey", F.inline(C.REASONS))


@query(
    "rejects_by_reason",
    f"""SELECT 'tpch' AS "schema", 'part' AS "table", reason, "column", count(*) AS n
        FROM ({_PART_REASONS}) GROUP BY reason, "column" """,
)
def rejects_by_reason(t: Tables) -> DataFrame:
    checked = C.check_rows(degraded_part(t), PART)
    return R.errors_by_reason(C.rejects(checked, ["p_partkey"], PART))


@query(
    "accepted_rows",
    f"""SELECT p_partkey, p_name, p_brand, p_type,
               CAST(CASE WHEN p_type = 'LARGE' THEN p_size * 1000 ELSE p_size END AS SMALLINT) AS p_size, p_retailprice
        FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM ({_PART_REASONS}))""",
)
def accepted_rows(t: Tables) -> DataFrame:
    rows = C.accepted(C.check_rows(degraded_part(t), PART)).drop("p_hash")
    return rows.withColumn("p_retailprice", F.col("p_retailprice").cast("double"))
