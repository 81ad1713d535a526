"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

A fingerprint has a bit for each bit that is set in over half of the hashes of a text's
word shingles. The fingerprints form a binary trie. Pairs of its nodes are followed
together from the root: each step adds the bits in which the two nodes differ, and a
pair that differs in more bits than allowed is given up with all that lies below it.

The upper part of the trie is walked with joins over tables of nodes, two levels at a
time, until a pair of nodes has so few fingerprints that one task can follow it to the
end. So dense parts of the trie are split further, however many fingerprints they have.
Below, a task hands on a spanning forest of the links it finds, never the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.llm import near_copies
from ferrywright.llm.common import components, fresh, numbered, settled, small_batches
from ferrywright.session import stage

SHINGLE = 3
MAX_BITS = 2
# Fingerprints that one task follows together, and levels of the trie per step above.
LEAF = 8192
STEP = 2
# Node pairs that a task holds at once, and fingerprint pairs below which nodes are compared directly.
_FRONTIER = 200_000
_DIRECT = 48
_BLOCK = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _word_blocks(text: bytes):
    """The words of a text, in lists of bounded size."""
    start = 0
    while start < len(text):
        end = start + _BLOCK
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end].split()
        start = end


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned; 0 if it has no word."""
    votes, n, last = np.zeros(64, np.int64), 0, []
    for words in _word_blocks((text or b"").translate(_LOWER)):
        words = last + words
        runs = [b" ".join(run) for run in zip(*(words[k:] for k in range(shingle)))]
        last = words[-(shingle - 1) :] if shingle > 1 else []
        if runs:
            hashes = np.array([xxhash.xxh64_intdigest(run, 42) for run in runs], "<u8")
            n += len(runs)
            for part in np.array_split(hashes, len(hashes) // 4096 + 1):
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes += bits.sum(axis=0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), 42) if last else 0
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Every column of `docs` but the text, and the fingerprint as a signed long."""
    small_batches(docs)
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*keep, name])

    return docs.mapInArrow(run, schema)


def _prefix(fp, depth: int):
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(fp, 64 - depth)


def _masks(max_bits: int):
    """The differences of two nodes over one step, by the bits that may still differ."""
    return [[m for m in range(1 << STEP) if m.bit_count() <= left] for left in range(max_bits + 1)]


def _leaf_pairs(fps: DataFrame, max_bits: int, leaf: int) -> list[tuple[int, DataFrame]]:
    """(depth, node pairs) that tasks are to follow: columns a, b, diff with a <= b."""
    total = fps.count()
    session, depth, found = fps.sparkSession, 0, []
    open_pairs = session.createDataFrame([(0, 0, 0, total)], "a long, b long, diff int, n long")
    if total <= leaf:
        return [(0, open_pairs)]
    masks = F.array(*[F.array(*[F.lit(m) for m in row]) for row in _masks(max_bits)])
    while True:
        below = depth + STEP
        nodes = fps.groupBy(_prefix(F.col("fp"), below).alias("node")).agg(F.count("*").alias("n"))
        nodes = stage(nodes.withColumn("up", F.shiftrightunsigned("node", STEP)), "nodes")
        left = open_pairs.select("a", "b", "diff").join(nodes.select(F.col("up").alias("a"), "node", "n"), "a")
        low = F.lit((1 << STEP) - 1)
        step = left.withColumn("m", F.explode(F.get(masks, F.lit(max_bits) - F.col("diff"))))
        step = step.select(
            F.col("a").alias("pa"),
            F.col("b").alias("pb"),
            F.col("node").alias("a"),
            F.shiftleft("b", STEP).bitwiseOR(F.col("node").bitwiseAND(low).bitwiseXOR(F.col("m"))).alias("b"),
            (F.col("diff") + F.bit_count("m")).alias("diff"),
            F.col("n").alias("na"),
        ).filter("pa < pb or a <= b")
        step = step.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        size = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        pairs = stage(step.select("a", "b", "diff", size.alias("n")), "node_pairs")
        # Below the last level a node is one fingerprint, so every pair is small then.
        found.append((below, pairs.filter(F.col("n") <= leaf)))
        open_pairs, depth = pairs.filter(F.col("n") > leaf), below
        if open_pairs.isEmpty():
            return found


def links(fps: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """Columns (a, b) of fingerprints: enough links of at most `max_bits` bits to connect all that are linked.

    `fps` holds distinct fingerprints in the long column fp.
    """
    parts = []
    for depth, pairs in _leaf_pairs(fps, max_bits, leaf):
        sides = pairs.select("a", "b", "diff", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        rows = fps.select("fp", _prefix(F.col("fp"), depth).alias("node")).join(sides, "node")
        parts.append(rows.select(F.lit(depth).alias("depth"), "a", "b", "diff", "fp"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)

    def follow(table: pa.Table) -> pa.Table:
        values = np.sort(table.column("fp").to_numpy().view(np.uint64))
        depth, a, b, diff = (table.column(c)[0].as_py() for c in ("depth", "a", "b", "diff"))
        parent = _forest(values, depth, a == b, diff, max_bits)
        child = np.flatnonzero(parent != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.table({"a": signed[child], "b": signed[parent[child]]})

    return rows.groupBy("depth", "a", "b").applyInArrow(follow, "a long, b long")


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    root = parent[of]
    while True:
        up = parent[root]
        if (up == root).all():
            return root
        root = up


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _forest(values: np.ndarray, depth: int, alone: bool, diff: int, max_bits: int) -> np.ndarray:
    """The parent of each of the sorted fingerprints of one node, or of two that differ in `diff` bits.

    A node of the trie is a range of the sorted fingerprints. All pairs of nodes of a
    level are followed at once, in portions of bounded size.
    """
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent
    if alone:
        first = np.array([[0, n, 0, n, diff]], np.int64)
    else:
        cut = int(np.searchsorted(values >> np.uint64(64 - depth), values[-1] >> np.uint64(64 - depth)))
        first = np.array([[0, cut, cut, n, diff]], np.int64)
        if cut == 0:  # the other node has no fingerprint here
            return parent
    zeros = {}
    stack = [(depth, first)]
    while stack:
        depth, at = stack.pop()
        small = (at[:, 1] - at[:, 0]) * (at[:, 3] - at[:, 2]) <= _DIRECT
        if depth == 64:
            small[:] = True
        if small.any():
            _compare(values, at[small], max_bits, parent)
            at = at[~small]
        if not len(at):
            continue
        if len(at) > _FRONTIER:
            half = len(at) // 2
            stack += [(depth, at[:half]), (depth, at[half:])]
            continue
        if depth not in zeros:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        z = zeros[depth]
        l0, l1, r0, r1, d = at.T
        lm, rm = l0 + z[l1] - z[l0], r0 + z[r1] - z[r0]
        same = l0 == r0
        kids = [
            np.stack([l0, lm, r0, rm, d], 1),
            np.stack([lm, l1, rm, r1, d], 1),
            np.stack([l0, lm, rm, r1, d + 1], 1),
            np.stack([lm, l1, r0, rm, d + 1], 1)[~same],
        ]
        at = np.concatenate(kids)
        at = at[(at[:, 0] < at[:, 1]) & (at[:, 2] < at[:, 3]) & (at[:, 4] <= max_bits)]
        stack.append((depth + 1, at))
    return _roots(parent, parent)


def _compare(values: np.ndarray, at: np.ndarray, max_bits: int, parent: np.ndarray) -> None:
    """Join the fingerprints of small node pairs that are close enough."""
    width = at[:, 3] - at[:, 2]
    count = (at[:, 1] - at[:, 0]) * width
    ends = np.cumsum(count)
    for part in np.array_split(np.arange(len(at)), int(ends[-1]) // 4_000_000 + 1):
        if not len(part):
            continue
        per = count[part]
        pair = np.repeat(part, per)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(per) - per, per)
        i, j = at[pair, 0] + inside // width[pair], at[pair, 2] + inside % width[pair]
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
        _union(parent, i[near], j[near])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of `docs`: its id, fingerprint (signed long fp) and component_id.

    component_id is the smallest id that links lead to, the row's own included. Null texts
    count as empty, texts without words have fingerprint zero and link like any other.
    Rows that repeat link with each other. Null ids are in a component but never name it;
    it is null where all ids are null. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    marked = stage(with_fingerprints(narrow), "fingerprints")
    by_fp = marked.groupBy("fp").agg(F.min("id").alias("low"))
    fps = stage(by_fp, "distinct_fingerprints")
    roots = components(links(fps.select("fp"), max_bits))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(placed.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_pairs(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of rows that the trie links, enough to connect all that are; `rows` has row (long, distinct) and text.

    Rows with one fingerprint are linked to the first of them, and those first ones as `links` says.
    """
    marked = stage(with_fingerprints(rows.select("row", "text")), "fingerprints")
    fps = stage(marked.groupBy("fp").agg(F.min("row").alias("low")), "distinct_fingerprints")
    equal = marked.join(fps, "fp").filter("row <> low").select(F.col("row").alias("a"), F.col("low").alias("b"))
    sides = [fps.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab"]
    close = links(fps.select("fp"), max_bits).join(sides[0], "a").join(sides[1], "b")
    return stage(equal.union(close.select("low_a", "low_b")), "near_pairs")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", t: float = near_copies.SIMILARITY, max_bits: int = MAX_BITS
) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that with the smallest id.

    The trie's links come first and are verified: sets of five-word shingles with a Jaccard
    similarity of at least `t`. Texts so similar may differ in up to a quarter of the bits,
    which the trie cannot follow without comparing all with all, and its forest leaves out
    links that others stand for. So `near_copies` tries all other pairs, whatever their bits:
    every link of that similarity is found, as a comparison of all texts with all would do.
    Of rows with equal ids the first in the table stays; a null id comes after all others.
    """
    docs = settled(docs)
    (row,) = fresh(docs, "_row")
    rows = numbered(docs, row)
    texts = rows.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    found = near_copies.groups(texts, t, near_pairs(texts, max_bits))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row))
    keys = rows.select(F.col(row).alias("row"), order.alias("key"))
    first = keys.join(found, "row").groupBy("root").agg(F.min("key").alias("low"))
    stay = first.select(F.col("low")[row].alias(row))
    return rows.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
