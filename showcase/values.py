"""Value transforms and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.functions import literals as L
from ferrywright.functions import values as V
from ferrywright.sinks.files import as_text
from ferrywright.sources.landing import CsvLayout
from showcase.registry import Tables, query


@query("ts_to_compact", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS compact FROM events")
def ts_to_compact(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.compact_datetime(F.col("ts")).alias("compact"))


@query(
    "compact_to_ts",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS datetime_text,
              strftime(o_orderdate, '%Y-%m-%d') AS date_text,
              CAST(o_orderdate AS TIMESTAMP) AS typed, CAST(o_orderdate AS DATE) AS day
       FROM orders""",
)
def compact_to_ts(t: Tables) -> DataFrame:
    stamp = V.compact_datetime(F.col("o_orderdate"))
    day = F.date_format("o_orderdate", V.COMPACT_DATE)
    landed = t.orders.select("o_orderkey", stamp.alias("stamp"), day.alias("day8"))
    return landed.select(
        "o_orderkey",
        V.expand_datetime(F.col("stamp")).alias("datetime_text"),
        V.expand_date(F.col("day8")).alias("date_text"),
        V.parse_datetime(F.col("stamp")).alias("typed"),
        V.parse_date(F.col("day8")).alias("day"),
    )


@query(
    "datetime_fallback",
    """SELECT o_orderkey,
              CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS parsed
       FROM orders""",
)
def datetime_fallback(t: Tables) -> DataFrame:
    c = F.col("o_orderdate")
    mixed = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("19971345000000"))
        .when(F.col("o_orderstatus") == "F", V.compact_datetime(c))
        .when(F.col("o_orderstatus") == "O", F.date_format(c, "yyyy/MM/dd"))
        .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    )
    formats = (V.COMPACT_DATETIME, "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")
    return t.orders.select("o_orderkey", V.parse_datetime(mixed, formats).alias("parsed"))


@query(
    "datetime_truncate",
    """SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS to_second,
              CAST(date_trunc('day', ts) AS TIMESTAMP) AS to_day FROM events""",
)
def datetime_truncate(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        V.truncate_datetime(F.col("ts"), "second").alias("to_second"),
        V.truncate_datetime(F.col("ts"), "day").alias("to_day"),
    )


@query(
    "null_marker_read",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority FROM orders""",
)
def null_marker_read(t: Tables) -> DataFrame:
    landed = F.when(F.col("o_orderstatus") == "P", V.NULL_MARKER).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", V.marker_to_null(landed).alias("priority"))


@query(
    "null_if_list",
    """SELECT o_orderkey,
              CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL ELSE o_orderpriority END AS listed,
              CASE WHEN lower(o_orderpriority) IN ('2-high') OR regexp_matches(o_orderpriority, '^1-') THEN NULL
                   ELSE o_orderpriority END AS identified
       FROM orders""",
)
def null_if_list(t: Tables) -> DataFrame:
    c = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        V.null_if(c, ["4-NOT SPECIFIED", "5-LOW"]).alias("listed"),
        V.null_identifiers(c, ["2-High"], case_sensitive=False, regex="^1-").alias("identified"),
    )


@query(
    "null_marker_write",
    r"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
               CASE WHEN o_orderstatus = 'P' THEN '\N' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderpriority = '5-LOW' THEN '(null)' ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
)
def null_marker_write(t: Tables) -> DataFrame:
    holes = t.orders.select(
        "o_orderkey",
        V.null_if(F.col("o_orderstatus"), ["P"]).alias("o_orderstatus"),
        V.null_if(F.col("o_orderpriority"), ["5-LOW"]).alias("o_orderpriority"),
    )
    return as_text(holes, CsvLayout(null_overrides={"O_ORDERPRIORITY": "(null)"}))


@query(
    "empty_to_null",
    "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_name END AS name FROM part",
)
def empty_to_null(t: Tables) -> DataFrame:
    blanked = F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", V.empty_to_null(blanked).alias("name"))


@query(
    "trim_text",
    r"""SELECT doc_id, regexp_replace(text, '^[\t\n\x0B\f\r \x{85}\p{Z}]+|[\t\n\x0B\f\r \x{85}\p{Z}]+$', '', 'g') AS trimmed
        FROM documents""",
)
def trim_text(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" \t　\n"), F.col("text"), F.lit(" \n \t"))
    return t.documents.select("doc_id", V.trim_text(padded).alias("trimmed"))


@query(
    "bool_to_bit",
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'maybe' WHEN quality = 1 THEN '1' ELSE '0' END AS bit,
              CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS mapped
       FROM labels""",
)
def bool_to_bit(t: Tables) -> DataFrame:
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    word = F.when(good & bad, "maybe").when(good, " Yes ").when(bad, "F").otherwise("FALSE")
    local = F.when(bad, "?").when(good, "oui").otherwise("non")
    return t.labels.select(
        "doc_id",
        V.boolean_to_bit(word).alias("bit"),
        V.map_boolean(local, {"oui": True, "non": False}).alias("mapped"),
    )


@query("binary_to_hex", "SELECT doc_id, lower(hex(encode(text))) AS hexed FROM documents")
def binary_to_hex(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.binary_to_hex(F.encode("text", "UTF-8")).alias("hexed"))


@query(
    "hex_to_binary",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_name END AS name,
              c_mktsegment IN ('BUILDING', 'MACHINERY') AS bad_hex
       FROM customer""",
)
def hex_to_binary(t: Tables) -> DataFrame:
    hexed = V.binary_to_hex(F.encode("c_name", "UTF-8"))
    landed = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(hexed, F.lit("0")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(hexed, F.lit("zz")))
        .otherwise(hexed)
    )
    rows = t.customer.select("c_custkey", landed.alias("landed"))
    return rows.select(
        "c_custkey",
        F.decode(V.hex_to_binary(F.col("landed")), "UTF-8").alias("name"),
        V.hex_to_binary(F.col("landed")).isNull().alias("bad_hex"),
    )


@query(
    "sql_literal",
    r"""SELECT doc_id, '''' || replace(text, '''', '''''') || '''' AS text_literal,
               CAST(n_chars AS VARCHAR) AS number_literal,
               CASE WHEN lang = 'en' THEN 'NULL' ELSE '''' || lang || '''' END AS marker_literal,
               CASE WHEN lang = 'en' THEN 'NULL' ELSE '''' || lang || '''' END AS oracle_literal
        FROM documents""",
)
def sql_literal(t: Tables) -> DataFrame:
    english = F.col("lang") == "en"
    return t.documents.select(
        "doc_id",
        L.sql_literal(F.col("text")).alias("text_literal"),
        L.sql_literal(F.col("n_chars").cast("string")).alias("number_literal"),
        L.sql_literal(F.when(english, V.NULL_MARKER).otherwise(F.col("lang"))).alias("marker_literal"),
        L.sql_literal(F.when(english, "").otherwise(F.col("lang")), "oracle").alias("oracle_literal"),
    )


@query(
    "csv_field",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\n\r]') THEN '"' || replace(text, '"', '""') || '"'
                            ELSE text END AS field,
               regexp_matches(text, '[,"\n\r]') AS quoted
        FROM documents""",
)
def csv_field(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", L.csv_field(c).alias("field"), V.needs_quote(c).alias("quoted"))


@query("newline_export", r"SELECT doc_id, regexp_replace(text, '\r?\n', ' ', 'g') AS line FROM documents")
def newline_export(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.newline_to(F.col("text")).alias("line"))


@query(
    "value_text",
    r"""SELECT CAST(o_orderkey AS VARCHAR) AS key_text,
               regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') AS price_text,
               strftime(o_orderdate, '%Y%m%d%H%M%S') AS date_text, o_orderstatus AS status_text,
               CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag_text
        FROM orders""",
)
def value_text(t: Tables) -> DataFrame:
    df = t.orders.withColumn("flag", F.col("o_orderstatus") == "F")
    texts = {
        "o_orderkey": "key_text",
        "o_totalprice": "price_text",
        "o_orderdate": "date_text",
        "o_orderstatus": "status_text",
        "flag": "flag_text",
    }
    return df.select(*[V.value_text(F.col(c), df.schema[c].dataType).alias(a) for c, a in texts.items()])


@query(
    "compact_mask",
    r"""SELECT o_orderkey, o_orderstatus = 'F' AS is_stamp, o_orderstatus = 'O' AS is_day FROM orders""",
)
def compact_mask(t: Tables) -> DataFrame:
    c = F.col("o_orderdate")
    landed = (
        F.when(F.col("o_orderstatus") == "F", V.compact_datetime(c))
        .when(F.col("o_orderstatus") == "O", F.date_format(c, V.COMPACT_DATE))
        .otherwise(F.date_format(c, "yyyy-MM-dd"))
    )
    return t.orders.select(
        "o_orderkey", V.is_digits(landed, 14).alias("is_stamp"), V.is_digits(landed, 8).alias("is_day")
    )


@query("marker_mask", "SELECT o_orderkey, o_orderstatus = 'P' AS is_marker FROM orders")
def marker_mask(t: Tables) -> DataFrame:
    landed = F.when(F.col("o_orderstatus") == "P", V.NULL_MARKER).otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", V.is_marker(landed).alias("is_marker"))


@query(
    "numeric_text_mask",
    r"""SELECT event_id, event_type IN ('click', 'view', 'signup') AS is_number FROM events""",
)
def numeric_text_mask(t: Tables) -> DataFrame:
    # Two decimals always, so that no value is printed with an exponent.
    plain = F.col("value").cast("decimal(20,2)").cast("string")
    landed = (
        F.when(F.col("event_type") == "click", plain)
        .when(F.col("event_type") == "view", F.concat(F.lit("-"), F.regexp_replace(plain, "^-", "")))
        .when(F.col("event_type") == "signup", F.concat(F.regexp_extract(plain, r"\d+", 0), F.lit(".")))
        .when(F.col("event_type") == "error", F.concat(plain, F.lit(".1")))
        .otherwise(F.lit("."))
    )
    return t.events.select("event_id", V.is_numeric_text(landed).alias("is_number"))


@query(
    "charset_decode",
    "SELECT doc_id, text AS latin1, text AS windows FROM documents",
)
def charset_decode(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        V.decode_bytes(F.encode("text", "ISO-8859-1"), "LATIN1").alias("latin1"),
        V.decode_bytes(F.encode("text", "windows-1252"), "WINDOWS-1252").alias("windows"),
    )


@query(
    "undecodable_kept",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || chr(65533) ELSE text END AS text,
              CASE WHEN doc_id % 7 = 3 THEN lower(hex(encode(text))) || 'ff' END AS original FROM documents""",
)
def undecodable_kept(t: Tables) -> DataFrame:
    # A byte that begins no character of UTF-8 behind some texts.
    stray = F.when(F.col("doc_id") % 7 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    found = V.decode_or_keep(F.concat(F.encode("text", "UTF-8"), stray), "UTF-8")
    rows = t.documents.select("doc_id", found.alias("found"))
    return rows.select("doc_id", "found.text", V.binary_to_hex(F.col("found.undecodable")).alias("original"))


@query(
    "gbk_decode",
    "SELECT p_partkey, '零件 ' || p_name AS gbk, '部品 ' || p_name AS sjis FROM part",
)
def gbk_decode(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        V.decode_bytes(F.encode(F.concat(F.lit("零件 "), "p_name"), "GBK"), "GB2312").alias("gbk"),
        V.decode_bytes(F.encode(F.concat(F.lit("部品 "), "p_name"), "Shift_JIS"), "SJIS").alias("sjis"),
    )
