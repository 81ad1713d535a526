"""Quality rules over lines: those that many documents of a host share are no content.

Lines are normalised (lower case, runs of white space and digits made equal) and hashed.
The distinct documents of a host that hold a line are counted; a line above the limit
is removed, and a document of which too little stays is rejected. Counts are reduced
before each shuffle, texts never move, and lines below the limit never meet a join twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import NOT_SPACE, fresh, numbered, settled, words_of
from ferrywright.session import stage

# A line is removed when more than this many documents of a host hold it, however large the host is.
MOST_DOCS = 20
# A document is rejected when fewer words, or a smaller share of its words, stay.
LEAST_WORDS = 10
LEAST_SHARE = 0.5
# The base rules: least words, and the largest percentage of words in repeated windows of five.
BASE_WORDS = 10
BASE_REPEATS = 20
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def normalised_lines(text: Column) -> Column:
    """The lines of a text as they are compared."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    plain = F.lower(F.regexp_replace(plain, "[0-9]+", "0"))
    return F.transform(F.split(plain, "\n"), lambda line: F.btrim(line))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Steps that several later ones read are columns of their own, so that none is computed
    anew for each element of an array.
    """
    words, lines, hashes, runs, sorted_runs, places = fresh(docs, "_words", "_lines", "_hashes", "_runs", "_sorted", "_at")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn(words, words_of(body))
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    with_word = F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE))
    out = out.withColumn(lines, with_word)
    n = F.size(words)

    def window(first: Column, at: Column) -> Column:
        return F.xxhash64(first, *[F.get(F.col(hashes), at + k) for k in range(1, WINDOW)])

    starts = F.when(n >= WINDOW, F.slice(F.col(hashes), F.lit(1), n - (WINDOW - 1)))
    out = out.withColumn(runs, F.transform(starts, window))
    # Only texts with a repeated window need their places.
    pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct(runs)) < F.size(runs)
    out = out.withColumn(sorted_runs, F.when(repeated, pairs))

    def in_group(e: Column, k: Column) -> Column:
        s = F.col(sorted_runs)
        alike = (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
        return F.when(alike, e["i"])

    found = F.sort_array(F.filter(F.transform(sorted_runs, in_group), lambda i: i.isNotNull()))
    out = out.withColumn(places, found)
    gaps = F.transform(places, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(places), k + 1) - i, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, g: total + g), F.lit(0))
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURES],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def document_lines(docs: DataFrame, row: str, id_col: str, host: str, text: str) -> DataFrame:
    """A row per line that has a word: row, id, host, hash and number of words."""
    lines = docs.select(
        F.col(row).alias("row"),
        F.col(id_col).alias("id"),
        F.col(host).alias("host"),
        F.explode(normalised_lines(F.col(text).cast("string"))).alias("line"),
    ).filter("line <> ''")
    return lines.select("row", "id", "host", F.xxhash64("line").alias("hash"), F.size(words_of(F.col("line"))).alias("n"))


def frequent_lines(lines: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """Columns (host, hash, n_docs) of the lines to remove."""
    return lines.groupBy("host", "hash").agg(F.count_distinct("id").alias("n_docs")).filter(F.col("n_docs") > most_docs)


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
    most_docs: int = MOST_DOCS,
) -> DataFrame:
    """`docs` without its text, with the base measures, n_removed_lines, n_removed_words and kept.

    A null text has no words, a null host is a host of its own, a null id counts as no
    document. Rows that repeat are one document to the counts, and each gets its result.
    A result takes the place of an input column of its name. An empty table gives no rows.
    """
    docs = settled(docs)
    (row,) = fresh(docs, "_row")
    rows = numbered(docs, row)
    lines = document_lines(rows, row, id_col, host, text)
    frequent = stage(frequent_lines(lines, most_docs), "frequent_lines")
    same = lines["host"].eqNullSafe(frequent["host"]) & (lines["hash"] == frequent["hash"])
    removed = lines.join(frequent, same, "left_semi").groupBy("row").agg(
        F.count("*").alias("n_removed_lines"), F.sum("n").cast("long").alias("n_removed_words")
    )
    measured = base_measures(rows, text).drop(text, "n_removed_lines", "n_removed_words", "kept")
    out = measured.join(removed.withColumnRenamed("row", row), row, "left").drop(row)
    out = out.fillna(0, ["n_removed_lines", "n_removed_words"])
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < LEAST_WORDS) | (left < F.lit(LEAST_SHARE) * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def remove_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
    most_docs: int = MOST_DOCS,
) -> DataFrame:
    """`docs` with the texts that stay when the lines above the limit are taken out; nulls stay null.

    Repeated rows are one document to the counts; an empty table gives no rows.
    """
    docs = settled(docs)
    row, gone = fresh(docs, "_row", "_gone")
    rows = numbered(docs, row)
    lines = document_lines(rows, row, id_col, host, text)
    frequent = stage(frequent_lines(lines, most_docs), "frequent_lines")
    same = lines["host"].eqNullSafe(frequent["host"]) & (lines["hash"] == frequent["hash"])
    # At most as many hashes as the document has lines.
    hits = lines.join(frequent, same, "left_semi").groupBy("row").agg(F.collect_set("hash").alias(gone))
    out = rows.join(hits.withColumnRenamed("row", row), row, "left")
    normal = F.transform(normalised_lines(F.col(text)), lambda line: F.xxhash64(line))
    stays = F.filter(
        F.arrays_zip(F.split(F.col(text), "\n").alias("line"), normal.alias("hash")),
        lambda e: ~F.array_contains(F.col(gone), e["hash"]),
    )
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(stays, lambda e: e["line"]), "\n"))
    return out.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, text FROM d),
runs AS (
  SELECT r, i, ws[i:i+4] AS run FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM runs) WHERE c > 1),
rep AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
raw AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
lines AS (
  SELECT r, doc_id, source, unnest(list_transform(string_split(lower(regexp_replace(regexp_replace(
    text, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')), chr(10)), lambda x: trim(x))) AS line FROM d),
words AS (SELECT *, len(string_split(line, ' ')) AS n FROM lines WHERE line <> ''),
freq AS (SELECT source, line FROM words GROUP BY source, line HAVING count(DISTINCT doc_id) > {MOST_DOCS}),
gone AS (
  SELECT r, count(*) AS n_removed_lines, sum(n) AS n_removed_words
  FROM words l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(raw.ls) - len(list_distinct(raw.ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
    CAST(coalesce(gone.n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (r) JOIN raw USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {LEAST_WORDS}
  AND n_words - n_removed_words >= CAST({LEAST_SHARE} AS DOUBLE) * n_words AS kept FROM b
"""
