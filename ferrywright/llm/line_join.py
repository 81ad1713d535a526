"""Exact set-similarity join of lines: later lines that match an earlier one are removed.

Lines are sets of words. Two match when the Jaccard similarity of their sets reaches the
threshold. The words of a line are ordered by rarity, so that matching lines must share
one of the first, rare words of both. Lines with equal sets are one line to the join.
What shares such a word is tested by the sizes, by the places of the word and by a
parity bitmap of the sets, which bounds their difference; what passes is tested by short
hashes of the words, and then verified on the whole sets, whose words are 64-bit hashes.
Of the pairs of a line the likeliest is verified first, the others if it fails.

In a group of many similar lines almost all are close to the first one that has the same
rare word. Such pairs of a line and the first or the previous one are tried before any
other; only lines that none of them settles meet all earlier lines, by words of more
lines than three. So a group of copies
costs about its size, not its square, and no pair is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.llm.common import NOT_SPACE, SPACES, fresh, numbered, settled, staged, words_of
from ferrywright.session import discard

SIMILARITY = 0.8
# Counters of words; a word's rarity is that of its counter, the order of rare words is refined by their length.
COUNTERS = 1 << 16
# Lines of more words than this have a parity bitmap of twice the length.
LONG_LINE = 40
# Broadcast no more lines than this when candidates are looked up.
MOST_BROADCAST = 500_000
# What the filters of two rows with a common word read.
FILTERED = ["n", "at", "bits", "more"]


def _lines(rows: DataFrame, row: str, id_col: str, text: str) -> DataFrame:
    """Columns id, row, line_no and line of each line that has words."""
    lines = rows.select(
        F.col(id_col).alias("id"), F.col(row).alias("row"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("line_no", "line")
    )
    # Told from the line, because a condition on its words would have them made twice.
    return lines.filter(F.col("line").rlike(NOT_SPACE))


def _code(word: Column) -> Column:
    """A word's hash of 48 bits, below a byte that is smaller for longer words."""
    shortness = F.lit(255) - F.least(F.octet_length(word), F.lit(255))
    return F.shiftleft(shortness.cast("long"), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 16))


def _counter(code: Column) -> Column:
    return code.bitwiseAND(F.lit(COUNTERS - 1).cast("long")).cast("int")


def _codes(line: Column) -> Column:
    """The codes of the different words of a line; numbers are compared faster than words."""
    return F.array_distinct(F.transform(words_of(line), _code))


def word_classes(rows: DataFrame, text: str) -> Column:
    """An array with the class of rarity of each counter of all words, above a code's bits, as a literal of fixed size."""
    words = rows.select(F.explode(F.split(F.col(text).cast("string"), SPACES)).alias("w")).filter("w <> ''")
    counts = words.groupBy(_counter(_code(F.col("w"))).alias("c")).agg(F.count("*").alias("n"))
    known = dict(counts.collect())  # at most COUNTERS rows, whatever the input
    usual = sorted(known.values())[len(known) // 2] if known else 1
    classes = (max(0, math.ceil(math.log2(known.get(c, 1) / (2 * usual)))) for c in range(COUNTERS))
    return F.split(F.lit(",".join(str(c << 56) for c in classes)), ",").cast("array<long>")


def _key(code: Column, classes: Column) -> Column:
    """A word's number; smaller numbers are rarer words. It is never null, so that arrays of it are sorted as plain numbers."""
    return F.coalesce(F.get(classes, _counter(code)), F.lit(0).cast("long")).bitwiseOR(code)


def _prefix_size(n: Column, t: float) -> Column:
    return n - F.ceil(F.lit(t) * n - F.lit(1e-9)).cast("int") + 1


def _least_overlap(n: Column, m: Column, t: float) -> Column:
    return F.ceil(F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9))


def _possible(a: dict[str, Column], b: dict[str, Column], t: float) -> Column:
    """Length, positional and parity filters for two rows with a common word, from their n, at, bits and more."""
    n, m = a["n"], b["n"]
    need = _least_overlap(n, m, t)
    length = (F.least(n, m) >= F.lit(t) * F.greatest(n, m) - 1e-9)
    place = 1 + F.least(n - a["at"] - 1, m - b["at"] - 1) >= need
    flips, more = (a[c].bitwiseXOR(b[c]) for c in ("bits", "more"))
    # Both halves of a long line's bitmap make, as one, the bitmap of a short line.
    halves = F.bit_count(flips) + F.bit_count(more)
    differ = F.when(F.least(n, m) > LONG_LINE, halves).otherwise(F.bit_count(flips.bitwiseXOR(more)))
    return length & place & (differ <= n + m - 2 * need)


def _likely(pairs: DataFrame, words: DataFrame, t: float) -> DataFrame:
    """Those of the pairs that hashes of 16 bits of their words do not rule out, with the common words at most."""
    size, low = F.size("words"), F.lit(0xFFFF).cast("long")
    short = F.array_distinct(F.transform("words", lambda w: (w.bitwiseAND(low) - 0x8000).cast("smallint")))
    sides = [
        words.select(
            F.col("row").alias(f"row{k}"), F.col("line_no").alias(f"line_no{k}"), size.alias(f"n{k}"), short.alias(f"short{k}")
        )
        for k in ("", "2")
    ]
    both = pairs.join(sides[0], ["row", "line_no"]).join(sides[1], ["row2", "line_no2"])
    # Words that share a hash count as one in the intersection.
    twice = F.least(*[F.col(f"n{k}") - F.size(f"short{k}") for k in ("", "2")])
    both = both.withColumn("most", F.size(F.array_intersect("short", "short2")) + twice)
    possible = F.col("most") >= _least_overlap(F.col("n"), F.col("n2"), t)
    return both.filter(possible).select(*pairs.columns, (F.col("most") / (F.col("n") + F.col("n2"))).alias("share"))


def _alike(pairs: DataFrame, words: DataFrame, t: float) -> DataFrame:
    """The lines (row, line_no) of those of the pairs whose sets reach the threshold."""
    other = words.select(F.col("row").alias("row2"), F.col("line_no").alias("line_no2"), F.col("words").alias("words2"))
    both = pairs.join(words, ["row", "line_no"]).join(other, ["row2", "line_no2"])
    common = F.size(F.array_intersect("words", "words2"))
    alike = common >= F.lit(t) * (F.size("words") + F.size("words2") - common) - 1e-9
    return both.filter(alike).select("row", "line_no").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, row: str, text: str, t: float) -> DataFrame:
    """Of pairs (row, line_no, row2, line_no2), the lines (row, line_no) whose pair reaches the threshold."""
    ends = pairs.select("row", "line_no").union(pairs.select("row2", "line_no2")).distinct()
    ends = staged(ends, "candidate_lines")
    small = ends.count() <= MOST_BROADCAST
    per_row = ends.groupBy("row").agg(F.collect_list("line_no").alias("nos"))
    docs = rows.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    found = docs.join(F.broadcast(per_row) if small else per_row, "row")
    # Texts are split before the numbers are unfolded, once each.
    found = found.select("row", "nos", F.split("text", "\n").alias("all"))
    lines = F.transform("nos", lambda i: F.struct(i.alias("line_no"), F.get(F.col("all"), i).alias("line")))
    lines = found.select("row", F.explode(lines).alias("l")).select("row", "l.*")
    # Pairs carry numbers of eight bytes, not the words.
    hashed = F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)))
    words = staged(lines.select("row", "line_no", hashed.alias("words")), "words")
    likely = staged(_likely(pairs, words, t), "likely_pairs")
    other = F.struct("row2", "line_no2")
    best = likely.groupBy("row", "line_no").agg(F.max_by(other, F.struct("share", other)).alias("o"))
    best = staged(best.select("row", "line_no", "o.*"), "likeliest_pairs")
    first = staged(_alike(best, words, t), "matched_first")
    rest = likely.drop("share").join(first, ["row", "line_no"], "left_anti")
    rest = rest.join(best, ["row", "line_no", "row2", "line_no2"], "left_anti")
    out = staged(first.union(_alike(rest, words, t)), "matched_lines")
    discard(ends, words, likely, best, first)
    return out


def kept_lines(rows: DataFrame, row: str, id_col: str, text: str, t: float = SIMILARITY) -> DataFrame:
    """Columns (row, line_no) of lines with words, but without a match among the earlier ones.

    Lines are ordered by id, then by row, then by their place; where `row` is the id, it is the whole order.
    """
    classes = word_classes(rows, text)
    keyed = _lines(rows, row, id_col, text).withColumn("codes", _codes(F.col("line")))
    keyed = keyed.withColumn("keys", F.sort_array(F.transform("codes", lambda c: _key(c, classes)))).withColumn("n", F.size("keys"))
    one, low = F.lit(1).cast("long"), F.lit(63).cast("long")
    flips = lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(low).cast("int")))
    parity = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), flips)
    half = F.filter("keys", lambda k: k.bitwiseAND(F.lit(64).cast("long")) != 0)
    order = ["row", "line_no"] if row == id_col else ["id", "row", "line_no"]
    sets = keyed.select(
        *order, "n",
        F.xxhash64("keys").alias("set"),
        parity(F.col("keys")).alias("bits"),
        F.when(F.col("n") > LONG_LINE, parity(half)).otherwise(F.lit(0).cast("long")).alias("more"),
        F.slice("keys", F.lit(1), _prefix_size(F.col("n"), t)).alias("prefix"),
    )
    # Equal sets are one line, the first of them; copies are reduced before the shuffle.
    first = sets.withColumn("place", F.row_number().over(W.partitionBy("set").orderBy(*order))).filter("place = 1")
    first = staged(first.drop("place", "set").withColumn("bits", F.col("bits").bitwiseXOR(F.col("more"))), "line_sets")
    # A set matches other sets only if it could match one of a word more: sets of one to three words only equal ones.
    wide = first.filter(F.col("n") >= F.lit(t) * (F.col("n") + 1) - 1e-9)
    seen = staged(_seen(wide, order, t), "seen_words")
    settled_lines = _settled_early(seen, rows, row, text, t)
    small = settled_lines.count() <= MOST_BROADCAST
    early = settled_lines.withColumn("early", F.lit(True))
    tokens = seen.filter("often").select("token", *order, "n", "at", "bits", "more")
    tokens = tokens.join(F.broadcast(early) if small else early, ["row", "line_no"], "left").withColumn("open", F.col("early").isNull())
    tokens = tokens.drop("early")
    earlier = F.struct(*[F.col(f"o.{c}") for c in order]) < F.struct(*[F.col(f"me.{c}") for c in order])
    # Said of both sides, so that both read the same shuffle: the words are equal, so it says that `me` is open.
    is_open = F.col("me.open") | (F.col("o.open") & (F.col("me.token") != F.col("o.token")))
    same = F.col("me.token") == F.col("o.token")
    me, other = ({c: F.col(f"{k}.{c}") for c in FILTERED} for k in ("me", "o"))
    pairs = tokens.alias("me").join(tokens.alias("o"), same & is_open & earlier & _possible(me, other, t))
    names = [F.col(f"me.{c}") for c in ("row", "line_no")] + [F.col(f"o.{c}").alias(f"{c}2") for c in ("row", "line_no")]
    pairs = staged(pairs.select(*names).distinct(), "pairs")
    later = _verified(pairs, rows, row, text, t)
    kept = staged(first.select("row", "line_no").join(settled_lines.union(later), ["row", "line_no"], "left_anti"), "kept_lines")
    discard(first, seen, settled_lines, pairs, later)
    return kept


def _seen(first: DataFrame, order: list[str], t: float) -> DataFrame:
    """The prefix words of lines that are of use: `often`, in four lines or more, or with a line that may match.

    Such a line is the first or the previous one with the word, as head_row, head_line_no,
    last_row and last_line_no, null where the filters rule it out. Of a word in up to three
    lines these are all pairs.
    """
    tokens = first.select(*order, "n", "bits", "more", F.posexplode("prefix").alias("at", "token"))
    by_token = W.partitionBy("token").orderBy(*order)
    # Plain columns, because a struct would be made ahead of the shuffle, and travel beside them.
    ends = ["row", "line_no"]
    others = [f.over(by_token).alias(f"{k}_{c}") for c in [*ends, *FILTERED] for k, f in (("head", F.first(c)), ("last", F.lag(c)))]
    whole = by_token.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = tokens.select("token", *order, *FILTERED, *others, (F.count("*").over(whole) > 3).alias("often"))
    me = {c: F.col(c) for c in FILTERED}
    for k in ("head", "last"):
        # The first line with a word has no other one.
        possible = F.col("last_n").isNotNull() & _possible(me, {c: F.col(f"{k}_{c}") for c in FILTERED}, t)
        found = found.withColumn(f"{k}_possible", possible)
    made = [F.when(F.col(f"{k}_possible"), F.col(f"{k}_{c}")).alias(f"{k}_{c}") for k in ("head", "last") for c in ends]
    return found.filter("often or head_possible or last_possible").select("token", *order, *FILTERED, "often", *made)


def _settled_early(seen: DataFrame, rows: DataFrame, row: str, text: str, t: float) -> DataFrame:
    """Columns (row, line_no) of lines that match the first or the previous line with one of their prefix words.

    Copies with words of their own share only later words of the prefix, so all of it is tried.
    """
    near = [
        seen.filter(f"{k}_row is not null").select("row", "line_no", F.col(f"{k}_row").alias("row2"), F.col(f"{k}_line_no").alias("line_no2"))
        for k in ("head", "last")
    ]
    pairs = staged(near[0].union(near[1]).distinct(), "near_pairs")
    out = _verified(pairs, rows, row, text, t)
    discard(pairs)
    return out


def _reviewed(docs: DataFrame, id_col: str, text: str, t: float) -> tuple[DataFrame, str]:
    """`docs` with the numbers of those of their lines with words that stay, and that column's name."""
    docs = settled(docs)
    row, kept = fresh(docs, "_row", "_kept")
    ids = docs.select(F.col(id_col).alias("id"))
    repeated = ids.groupBy("id").count().filter("id is null or count > 1").limit(1).count()
    # Ids that tell the rows apart are used as they are; else rows get numbers.
    if not repeated and docs.schema[id_col].dataType == T.LongType():
        row, rows = id_col, docs
    else:
        rows = numbered(docs, row)
    by_row = kept_lines(rows, row, id_col, text, t).groupBy("row").agg(F.collect_list("line_no").alias(kept))
    return rows.join(by_row.withColumnRenamed("row", row), row, "left"), kept


def _removed(text: Column, kept: Column) -> Column:
    """The numbers of removed lines of a text, in order."""
    compared = F.transform(
        F.split(text, "\n"), lambda line, i: F.when(line.rlike(NOT_SPACE), i)
    )
    numbers = F.filter(compared, lambda i: i.isNotNull())
    return F.coalesce(F.array_except(numbers, F.coalesce(kept, F.array().cast("array<int>"))), F.array().cast("array<int>"))


def line_matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", t: float = SIMILARITY) -> DataFrame:
    """Per row of `docs`: its id, n_lines, n_removed, and removed, the numbers of the removed lines joined by commas.

    Every line with a word is compared, however short; lines without words stay. Null and empty texts have no line
    with words. Rows that repeat match each other, the first in the table stays. A null id
    comes before all others. An empty table gives no rows.
    """
    rows, kept = _reviewed(docs, id_col, text, t)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = rows.select(F.col(id_col), F.size(F.split(body, "\n")).alias("n_lines"), _removed(body, F.col(kept)).alias("gone"))
    return out.select(id_col, "n_lines", F.size("gone").alias("n_removed"), F.array_join("gone", ",").alias("removed"))


def drop_matching_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", t: float = SIMILARITY) -> DataFrame:
    """`docs` without the lines that match an earlier one; null texts stay null.

    As `line_matches` says.
    """
    rows, kept = _reviewed(docs, id_col, text, t)
    body = F.col(text).cast("string")
    (gone,) = fresh(rows, "_gone")
    rows = rows.withColumn(gone, _removed(body, F.col(kept)))
    stay = F.filter(F.split(body, "\n"), lambda line, i: ~F.array_contains(F.col(gone), i))
    cleaned = F.when(F.size(gone) > 0, F.array_join(stay, "\n")).otherwise(body)
    return rows.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line_no, list_distinct(list_filter(
    regexp_split_to_array(ls[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))),
c AS (SELECT doc_id, line_no, len(ws) AS n, ws FROM l WHERE len(ws) > 0),
w AS (SELECT doc_id, line_no, n, unnest(ws) AS w FROM c),
f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
p AS (
  SELECT doc_id, line_no, n, w FROM (
    SELECT w.*, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY f.f, w.w) AS k FROM w JOIN f USING (w))
  WHERE k <= n - ceil({SIMILARITY} * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.doc_id, a.line_no, b.doc_id AS doc2, b.line_no AS line2 FROM p a JOIN p b USING (w)
  WHERE (b.doc_id, b.line_no) < (a.doc_id, a.line_no) AND least(a.n, b.n) >= {SIMILARITY} * greatest(a.n, b.n) - 1e-9),
gone AS (
  SELECT DISTINCT q.doc_id, q.line_no FROM pairs q
  JOIN c a ON a.doc_id = q.doc_id AND a.line_no = q.line_no JOIN c b ON b.doc_id = q.doc2 AND b.line_no = q.line2
  WHERE len(list_intersect(a.ws, b.ws)) >=
    {SIMILARITY} * (a.n + b.n - len(list_intersect(a.ws, b.ws))) - 1e-9),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines,
  CAST(coalesce(r.n, 0) AS INTEGER) AS n_removed, coalesce(r.removed, '') AS removed
FROM d LEFT JOIN r USING (doc_id)
"""
