"""The trie of conversation prefixes, with what sharing each prefix saves.

Every conversation is rebuilt from the first turns of its base and its own later turns. A
prefix is known by a digest, and most prefixes belong to one conversation only. A count-min
sketch over all digests never counts too low, so a count of one proves that a prefix is not
shared: its nodes are complete in the conversation's own row. Only prefixes that may be
shared are shuffled, to be grouped exactly. A sketch that is too small for the input sends
more prefixes that way and changes no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrywright.llm.common import staged
from ferrywright.session import discard

# A base gives at most SHARED - 1 turns to the GROUP conversations from it on.
GROUP = 100
SHARED = 6
# Counters of the sketch: rows, and the largest width of a row. A counter takes a byte.
SKETCH_ROWS = 4
MOST_WIDTH = 1 << 25
# Counters that travel in one row while the sketches of the tasks are added up.
_SLICE = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, chars, place, shared, digest) of every turn, without its text.

    Turns are ordered by turn, null first; equal ones by role and by the SHA-256 of the
    text. shared is how many first turns the conversation takes from its base. Rows with a
    null conv_id belong to no conversation and are left out.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("digest"),
        F.char_length(text).alias("chars"),
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return turns.select(
        "conv_id", "chars", F.row_number().over(in_order).alias("place"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("shared"),
        # Role and text as one digest; the role's length keeps ("ab", "c") and ("a", "bc") apart.
        F.sha2(F.concat_ws(":", F.char_length("role"), "role", "digest"), 256).alias("digest"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, size, chars, d1, d2, p1, p2), one row per prefix of a rebuilt conversation.

    `turns` is a stored copy of `ordered_turns`, which is read three times. size is the
    number of a conversation's turns, chars the code points of the prefix's last text, (d1,
    d2) the digest of the prefix and (p1, p2) that of the prefix before. Depth 0 is the
    prefix without turns, which every conversation has. The base of a conversation is
    conv_id - conv_id % GROUP, truncated towards zero, as in SQL.
    """
    own = turns.filter("place > shared").select("conv_id", F.lit(2).alias("part"), "place", "digest", "chars")
    # Only a base's first turns are ever shared: at most SHARED - 1 rows of every hundredth conversation.
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("place") < SHARED))
    heads = heads.select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    ids = turns.filter("place = 1").select("conv_id", "shared", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    given = ids.join(heads, "base").filter("place <= shared").select("conv_id", F.lit(1).alias("part"), "place", "digest", "chars")
    start = ids.select("conv_id", F.lit(0), F.lit(0), F.lit(""), F.lit(0))
    path = Window.partitionBy("conv_id").orderBy("part", "place")
    numbered = own.union(given).union(start).select(
        "conv_id", "chars", "digest", (F.row_number().over(path) - 1).alias("depth"),
        (F.count("*").over(Window.partitionBy("conv_id")) - 1).cast("int").alias("size"),
    )
    # A turn's hash holds its depth, so the sum of the hashes knows their order.
    by_depth = Window.partitionBy("conv_id").orderBy("depth")
    so_far = by_depth.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = [F.xxhash64("depth", "digest"), F.xxhash64(F.lit("second"), "digest", "depth")]
    digests = numbered.select("*", *(F.bit_xor(m).over(so_far).alias(f"d{k}") for k, m in enumerate(mixed, 1)))
    return digests.select(
        "conv_id", "depth", "size", "chars", "d1", "d2",
        *(F.coalesce(F.lag(f"d{k}").over(by_depth), F.lit(0)).cast("long").alias(f"p{k}") for k in (1, 2)),
    )


class Sketch:
    """Counters of 0, 1 and more in SKETCH_ROWS rows of a power of two."""

    def __init__(self, width: int, counters: np.ndarray | None = None):
        self.width = width
        self.counters = np.zeros(SKETCH_ROWS * width, np.uint8) if counters is None else counters

    def _places(self, row: int, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        # One more hash function for each row from two.
        mixed = d1.astype(np.uint64) + np.uint64(row) * (d2.astype(np.uint64) | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        return (mixed & np.uint64(self.width - 1)).astype(np.int64) + row * self.width

    def add(self, d1: np.ndarray, d2: np.ndarray) -> None:
        for row in range(SKETCH_ROWS):
            place, n = np.unique(self._places(row, d1, d2), return_counts=True)
            self.counters[place] = np.minimum(self.counters[place] + np.minimum(n, 2), 2)

    def alone(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Where the count is one at most: nothing else has this digest."""
        least = np.full(len(d1), 2, np.uint8)
        for row in range(SKETCH_ROWS):
            least = np.minimum(least, self.counters[self._places(row, d1, d2)])
        return least <= 1


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def sketch(prefixes: DataFrame, width: int) -> Sketch:
    """The sketch of (d1, d2) of all rows: one per task, then added up slice by slice.

    A task sends the places of its counters that are not zero, two bytes each, so that all
    tasks together send no more than the rows they have seen.
    """

    def count(batches):
        own = Sketch(width)
        for batch in batches:
            own.add(*_columns(batch, "d1", "d2"))
        for at in range(0, len(own.counters), _SLICE):
            part = own.counters[at : at + _SLICE]
            if part.any():
                yield _sparse(at, part)

    def add_up(batches):
        # The rows of a slice come one after the other.
        last, total = None, np.zeros(_SLICE, np.uint8)
        for batch in batches:
            for at, ones, more in zip(*(batch.column(c).to_pylist() for c in ("at", "ones", "more"))):
                if at != last:
                    if last is not None:
                        yield _sparse(last, total)
                    last, total = at, np.zeros(_SLICE, np.uint8)
                _put(total, ones, more)
        if last is not None:
            yield _sparse(last, total)

    schema = "at long, ones binary, more binary"
    parts = prefixes.select("d1", "d2").mapInArrow(count, schema)
    merged = parts.repartition("at").sortWithinPartitions("at").mapInArrow(add_up, schema)
    out = Sketch(width)
    for at, ones, more in merged.toLocalIterator():  # at most SKETCH_ROWS x MOST_WIDTH places
        _put(out.counters[at : at + _SLICE], bytes(ones), bytes(more))
    return out


def _sparse(at: int, counters: np.ndarray) -> pa.RecordBatch:
    places = [np.flatnonzero(counters == k).astype(np.uint16).tobytes() for k in (1, 2)]
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int64()), *(pa.array([p], pa.binary()) for p in places)], ["at", "ones", "more"]
    )


def _put(counters: np.ndarray, ones: bytes, more: bytes) -> None:
    one = np.frombuffer(ones, np.uint16)
    counters[one] = np.minimum(counters[one] + 1, 2)
    counters[np.frombuffer(more, np.uint16)] = 2


def _marked(prefixes: DataFrame, found: Sketch) -> DataFrame:
    """`prefixes` with `alone` and `parent_alone`, which the sketch proves."""
    shared = prefixes.sparkSession.sparkContext.broadcast((found.width, found.counters))

    def run(batches):
        known = Sketch(*shared.value)
        for batch in batches:
            marks = [pa.array(known.alone(*_columns(batch, *pair))) for pair in (("d1", "d2"), ("p1", "p2"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, "alone", "parent_alone"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in prefixes.schema)}, alone boolean, parent_alone boolean"
    return prefixes.mapInArrow(run, schema)


def _ends(members: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of rows (d1, d2, conv_id): the digest of the sorted ids.

    A digest is made in one place and in order; the ids stream through it, so that a node of
    any number of members needs no memory.
    """

    def run(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for d1, d2, conv_id in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "conv_id"))):
                if (d1, d2) == node:
                    digest.update(b",%d" % conv_id)
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (d1, d2), hashlib.sha256(b"%d" % conv_id)
            yield _rows(out)
        if node:
            yield _rows([(*node, digest.hexdigest())])

    ordered = members.select("d1", "d2", "conv_id").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id")
    return ordered.mapInArrow(run, "d1 long, d2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["d1", "d2", "ends_sha256"])


def _alone(rows: DataFrame, stats: DataFrame, root: int) -> DataFrame:
    """Nodes of one conversation, from its own rows; only the first of each asks for its parent."""
    known = (F.col("depth") == 1) | F.col("parent_alone")
    parent = F.when(F.col("depth") == 1, root).otherwise(F.col("conv_id"))
    inner = rows.filter(known).select("*", parent.cast("long").alias("parent_conv_id"))
    parents = stats.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("least").alias("parent_conv_id"))
    first = rows.filter(~known).join(parents, ["p1", "p2"])
    ends = F.when(F.col("depth") == F.col("size"), F.sha2(F.col("conv_id").cast("string"), 256))
    return inner.unionByName(first.select(*inner.columns)).select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).alias("n_convs"),
        (F.col("depth") < F.col("size")).cast("int").alias("n_children"), F.lit(1).alias("n_leaves"),
        F.lit(0).alias("saved_tokens"), F.coalesce(ends, F.lit(_EMPTY)).alias("ends_sha256"),
    )


def _shared(rows: DataFrame, stats: DataFrame, root: int) -> DataFrame:
    """Nodes that may be shared, grouped exactly.

    What a subtree sums up is dealt out to the members of its top: each node below counts at
    its smallest member, whose path leads through the top. So a node's sums are those of its
    members' rows, and nothing climbs the trie level by level.
    """
    path = Window.partitionBy("conv_id").orderBy("depth")
    whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = path.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at_end = F.col("depth") == F.col("size")
    mine = F.col("least") == F.col("conv_id")
    # A depth that stands in no row here is that of a prefix which is not shared.
    child = F.when(at_end, False).when(F.lead("depth").over(path) == F.col("depth") + 1, F.lead(mine).over(path)).otherwise(True)
    leaf = F.when(at_end, mine & (F.col("most") == F.col("depth"))).otherwise(True)
    parent = F.when(F.col("depth") == 1, root).when(F.col("parent_alone"), F.col("conv_id")).otherwise(F.lag("least").over(path))
    saved = F.when(mine, (F.col("n") - 1) * F.col("chars")).otherwise(0)
    each = rows.join(stats, ["d1", "d2"]).select(
        "depth", "d1", "d2", "least", "n", child.cast("int").alias("child"), F.last(leaf).over(whole).cast("int").alias("leaf"),
        F.when(mine, parent).alias("parent"), F.sum(saved).over(below).alias("saved"),
    )
    found = each.groupBy("d1", "d2").agg(
        F.max("least").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent_conv_id"),
        F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    return found.join(_ends(rows.filter("depth = size")), ["d1", "d2"], "left").select(
        *COLUMNS[:-1], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )


def nodes(conversations: DataFrame, width: int | None = None) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `conversations` has conv_id, turn, role and text; other columns take no part. Null and
    empty texts and roles are the same; repeated rows are turns of their own; a table
    without conversations has no root and gives no rows. `width` is that of the sketch, a
    power of two; by default twice the number of prefixes or more, at most MOST_WIDTH.
    """
    spark = conversations.sparkSession
    turns = staged(ordered_turns(conversations), "turns")
    prefixes = staged(rebuilt(turns), "prefixes")
    discard(turns)
    total = prefixes.count()
    width = width or min(MOST_WIDTH, max(_SLICE, 1 << (2 * total).bit_length()))
    rows = staged(_marked(prefixes, sketch(prefixes, width)), "marked")
    root = prefixes.filter("depth = 0").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    schema = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS)
    if not root.n:
        return spark.createDataFrame([], schema)
    maybe = rows.filter("depth > 0 and not alone")
    stats = staged(
        maybe.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("size").alias("most")), "stats"
    )
    found = _alone(rows.filter("depth > 0 and alone"), stats, root.least).unionByName(_shared(maybe, stats, root.least))
    found = staged(found.select(*(F.col(c).cast("string" if c == "ends_sha256" else "long") for c in COLUMNS)), "nodes")
    top = found.filter("depth = 1").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    turnless = _ends(prefixes.filter("size = 0")).first()
    values = (root.least, 0, None, root.n, top[0], top[1] or 1, top[2] or 0, turnless.ends_sha256 if turnless else _EMPTY)
    discard(prefixes, rows, stats)
    return found.union(spark.createDataFrame([values], schema))


# The same in DuckDB: crc32 from its polynomial, prefixes as lists of turns.
ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
turns AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, base FROM turns), crc),
paths AS (
  SELECT ids.conv_id,
         coalesce((SELECT list({role: t.role, text: t.text} ORDER BY t.place) FROM turns t WHERE t.conv_id = ids.base AND t.place <= h), [])
         || coalesce((SELECT list({role: t.role, text: t.text} ORDER BY t.place) FROM turns t WHERE t.conv_id = ids.conv_id AND t.place > h), [])
         AS path
  FROM ids),
members AS (
  SELECT conv_id, d AS depth, path[1:d] AS prefix, len(path) = d AS ends
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN any_value(depth) = 0 THEN 0 ELSE length(prefix[-1].text) END AS own
  FROM members GROUP BY prefix),
family AS (
  SELECT c.*, p.conv_id AS parent_conv_id, p.prefix AS parent
  FROM nodes c LEFT JOIN nodes p ON c.depth = p.depth + 1 AND c.prefix[1:c.depth - 1] = p.prefix),
children AS (SELECT parent AS prefix, count(*) AS n_children FROM family WHERE parent IS NOT NULL GROUP BY parent),
known AS (SELECT family.*, coalesce(n_children, 0) AS n_children FROM family LEFT JOIN children USING (prefix)),
sums AS (
  SELECT prefix[1:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM (SELECT prefix, n_children, own, unnest(range(0, depth + 1)) AS d FROM known) GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM known JOIN sums USING (prefix)
"""
