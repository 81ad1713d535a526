"""Near-duplicates of vectors by range search in a robust-pruned flat graph.

Equal vectors of a label are one node. The nodes of a label are split around pivots into
shards of bounded size that overlap, as every node goes to its two nearest pivots. Each
shard's nodes are linked to near ones, pruned so that no kept neighbour is much nearer to
a candidate than the node itself. The adjacency lists of all shards are united, and each
shard is searched, together with the neighbours of its nodes in others: greedily from its
medoid, and on through every node in range. Pairs are verified in double precision. The
recall of a sample is measured against all vectors; below the target the search is wider.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrywright.llm.common import components, numbered, settled
from ferrywright.session import stage

COSINE = 0.98
# Nodes of a shard at most, pivots of a split, and nodes that one task deals out to pivots.
SHARD = 3000
PIVOTS = 64
DEALT = 8192
# Neighbours of a node in one shard, candidates they are chosen from, and how much nearer one may be to another.
DEGREE = 20
CANDIDATES = 64
ALPHA = 1.2
# Width of the greedy search; sampled vectors of the audit and the recall it asks for.
BEAM = 24
AUDIT = 1000
RECALL = 0.97
_QUERIES = 256
_LEVELS = 12


def _matrix(column) -> np.ndarray:
    """Unit vectors in double precision of an Arrow column of lists of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(lists), -1)
    # Scaled first, so that squares neither vanish nor overflow.
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def nodes_of(rows: DataFrame, label: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows with node, nodes) of the valid rows: a node per label and vector, with its number of rows."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & fine & F.exists(values, lambda x: x != 0))
    # Minus zero is zero.
    valid = valid.select("row", F.col(label).cast("string").alias("label"), F.transform(values, lambda x: x + 0.0).alias("v"))
    nodes = valid.groupBy("label", "v").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    nodes = stage(nodes.withColumn("part", F.concat_ws("#", "label", F.size("v"))), "vector_nodes")
    members = valid.join(nodes.select("label", "v", "node"), ["label", "v"]).select("row", "node")
    return members, nodes


def shards_of(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Columns (shard, node, v): every node in one or more shards of bounded size, all of one label and dimension."""
    parts, done = nodes.select(F.col("part").alias("shard"), "node", "v"), []
    for _ in range(_LEVELS):
        sizes = parts.groupBy("shard").agg(F.count("*").alias("n"))
        big = stage(sizes.filter(F.col("n") > shard), "big_shards")
        if big.isEmpty():
            break
        done.append(parts.join(big, "shard", "left_anti"))
        large = parts.join(big, "shard")
        k = F.least(F.lit(PIVOTS), F.ceil(2.5 * F.col("n") / F.lit(shard)) + 1)
        place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("node"), "node"))
        pivots = large.withColumn("p", place).filter(F.col("p") <= PIVOTS).filter(F.col("p") <= k)
        spread = F.ceil(F.col("n") / F.lit(DEALT)).cast("int")
        pivots = pivots.select(
            F.col("shard").alias("shard"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), "p", F.col("v").alias("v")
        )
        dealt = large.select("shard", F.pmod(F.xxhash64("node", F.lit("salt")), spread).cast("int").alias("salt"), "node", "v")

        def deal(rows: pa.Table, pivots: pa.Table) -> pa.Table:
            schema = pa.schema([("shard", pa.string()), ("node", pa.int64()), ("v", pa.list_(pa.float64()))])
            if not len(rows):
                return schema.empty_table()
            pivots = pivots.sort_by("p")
            near = _matrix(rows.column("v")) @ _matrix(pivots.column("v")).T
            two = np.argsort(-near, axis=1, kind="stable")[:, :2]
            take = np.repeat(np.arange(len(rows)), two.shape[1])
            name = rows.column("shard")[0].as_py()
            names = [f"{name}/{k}" for k in two.ravel()]
            return pa.table([pa.array(names), rows.column("node").take(take), rows.column("v").take(take)], schema=schema)

        pairs = dealt.groupBy("shard", "salt").cogroup(pivots.groupBy("shard", "salt"))
        parts = stage(pairs.applyInArrow(deal, "shard string, node long, v array<double>"), "shards")
    for part in done:
        parts = parts.union(part)
    return stage(parts, "all_shards")


def prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """The robust-pruned neighbours of each unit vector: the nearest candidate is kept, and those go that are nearer to it."""
    n = len(x)
    c = min(candidates, n - 1)
    # Which neighbours are kept decides what the search reads, not which pairs it verifies.
    x = x.astype(np.float32)
    out: list[np.ndarray] = []
    if c < 1:
        return [np.array([], np.int64)] * n
    for lo in range(0, n, _QUERIES):
        part = np.arange(lo, min(n, lo + _QUERIES))
        near = x[part] @ x.T
        near[np.arange(len(part)), part] = -2
        # Half of the candidates are the nearest, the others lead to the rest of the shard.
        close = np.argpartition(-near, min(c, n - 2), axis=1)[:, :c] if c < n - 1 else np.argsort(-near, axis=1)[:, :c]
        far = (part[:, None] + np.arange(1, 5) * max(1, n // 5)) % n
        pool = np.concatenate([close, far], axis=1)
        d = 1 - np.take_along_axis(near, pool, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, order, axis=1), np.take_along_axis(d, order, axis=1)
        between = 1 - x[pool] @ x[pool].transpose(0, 2, 1)
        alive, kept = d < 3, [[] for _ in part]
        rows = np.arange(len(part))
        for _ in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            for q in np.flatnonzero(some):
                kept[q].append(int(pool[q, first[q]]))
            alive &= ~((alpha * between[rows, first] <= d) & some[:, None])
            alive[rows, first] = False
            alive &= pool != pool[rows, first][:, None]
        out += [np.array(k, np.int64) for k in kept]
    return out


def search(x: np.ndarray, ptr: np.ndarray, nbr: np.ndarray, entry: int, queries: np.ndarray, cosine: float, beam: int):
    """Pairs (query, node) in range: best-first from the entry, and through all nodes in range.

    Of each query only the `beam` best nodes are held, and whether they were visited. Single
    precision leads the way; the pairs are verified in double.
    """
    n, m = len(x), len(queries)
    single = x.astype(np.float32)
    asked = single[queries]
    seen = np.zeros((m, n), bool)
    top, at, done = np.full((m, beam), -2.0, np.float32), np.zeros((m, beam), np.int64), np.ones((m, beam), bool)
    found_q, found_n = [], []
    q, node = np.arange(m), np.full(m, entry)
    while True:
        seen[q, node] = True
        score = np.concatenate(
            [
                np.einsum("ij,ij->i", asked.take(q[k : k + 50_000], axis=0), single.take(node[k : k + 50_000], axis=0))
                for k in range(0, len(q), 50_000)
            ]
            or [np.zeros(0, np.float32)]
        )
        ranged = score >= cosine - 1e-5
        found_q.append(q[ranged])
        found_n.append(node[ranged])
        if len(q):
            order = np.lexsort((-score, q))
            count = np.bincount(q, minlength=m)
            some = np.flatnonzero(count)
            count = count[some]
            place = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            order, row, place = (v[place < beam] for v in (order, np.repeat(np.arange(len(some)), count), place))
            more = np.full((len(some), beam), -2.0, np.float32), np.zeros((len(some), beam), np.int64), np.ones((len(some), beam), bool)
            # Nodes in range are visited next, whatever their place.
            for all_new, new in zip(more, (score, node, ranged), strict=True):
                all_new[row, place] = new[order]
            now = [np.concatenate([old[some], new], axis=1) for old, new in zip((top, at, done), more, strict=True)]
            best = np.argpartition(-now[0], beam - 1, axis=1)[:, :beam]
            for old, new in zip((top, at, done), now, strict=True):
                old[some] = np.take_along_axis(new, best, axis=1)
        # Queries without new nodes in range visit the best of theirs.
        waiting = np.where(done, np.float32(-3), top)
        best = waiting.argmax(axis=1)
        free = waiting[np.arange(m), best] > -2
        free[q[ranged]] = False
        free = np.flatnonzero(free)
        done[free, best[free]] = True
        from_q, from_n = np.concatenate([q[ranged], free]), np.concatenate([node[ranged], at[free, best[free]]])
        if not len(from_q):
            break
        count = ptr[from_n + 1] - ptr[from_n]
        other = nbr[np.repeat(ptr[from_n], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        q = np.repeat(from_q, count)
        key = q * n + other
        key = np.sort(key[~seen.ravel()[key]])
        key = key[np.diff(key, prepend=-1) > 0]
        q, node = key // n, key % n
    q, node = np.concatenate(found_q), np.concatenate(found_n)
    left, right = [q[:0]], [q[:0]]
    for k in range(0, len(q), 50_000):
        a, b = queries[q[k : k + 50_000]], node[k : k + 50_000]
        fine = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        left.append(a[fine])
        right.append(b[fine])
    return np.concatenate(left), np.concatenate(right)


def build(shards: DataFrame) -> DataFrame:
    """Columns (node, nbrs): the united adjacency lists of all shards, in both directions."""

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids = table.column("node").to_numpy()
        near = prune(_matrix(table.column("v")))
        src = np.repeat(ids, [len(k) for k in near])
        dst = ids[np.concatenate(near)] if near else ids[:0]
        return pa.table({"a": src, "b": dst})

    edges = shards.groupBy("shard").applyInArrow(link, "a long, b long")
    both = edges.union(edges.select("b", "a")).groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("nbrs"))
    return stage(both.withColumnRenamed("a", "node"), "adjacency")


def range_pairs(nodes: DataFrame, shards: DataFrame, graph: DataFrame, cosine: float, beam: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes of a label that the search finds in range."""
    members = shards.select("shard", "node").withColumn("own", F.lit(True))
    around = members.join(graph, "node").select("shard", F.explode("nbrs").alias("node")).distinct()
    around = around.join(members.select("shard", "node"), ["shard", "node"], "left_anti").withColumn("own", F.lit(False))
    all_nodes = members.union(around).join(nodes.select("node", "v"), "node").join(graph, "node", "left")

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        x = _matrix(table.column("v"))
        lists = table.column("nbrs").combine_chunks()
        lens = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[place] == flat
        src = np.repeat(np.arange(len(ids)), lens)[here]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
        inside = np.flatnonzero(own)
        middle = x[inside].mean(axis=0)
        entry = int(inside[np.argmax(x[inside] @ middle)])
        found = [inside[:0]]
        for lo in range(0, len(inside), _QUERIES):
            q, node = search(x, ptr, place[here], entry, inside[lo : lo + _QUERIES], cosine, beam)
            apart = q != node
            found.append(np.minimum(q, node)[apart] * len(ids) + np.maximum(q, node)[apart])
        key = np.unique(np.concatenate(found))
        return pa.table({"a": ids[key // len(ids)], "b": ids[key % len(ids)]})

    return all_nodes.groupBy("shard").applyInArrow(find, "a long, b long").distinct()


def audited_recall(nodes: DataFrame, pairs: DataFrame, cosine: float, sample: int = AUDIT) -> float:
    """The share of the pairs of at most `sample` nodes, found by comparison with all nodes, that are among `pairs`."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "part", "v").toArrow()
    if not len(chosen):
        return 1.0
    queries: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in set(chosen.column("part").to_pylist()):
        own = chosen.filter(pa.compute.equal(chosen.column("part"), part))
        queries[part] = own.column("node").to_numpy(), _matrix(own.column("v"))

    def compare(batches):
        for batch in batches:
            for part in set(batch.column("part").to_pylist()) & set(queries):
                own = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch.column("part"), part))
                ids, x = queries[part]
                other = own.column("node").to_numpy()
                q, node = np.nonzero(x @ _matrix(own.column("v")).T >= cosine)
                apart = ids[q] != other[node]
                low, high = np.minimum(ids[q], other[node])[apart], np.maximum(ids[q], other[node])[apart]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    truth = nodes.select("node", "part", "v").mapInArrow(compare, "a long, b long").distinct()
    got = truth.join(pairs.withColumn("got", F.lit(1)), ["a", "b"], "left").agg(F.count("*"), F.count("got")).first()
    return got[1] / got[0] if got[0] else 1.0


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
    beam: int = BEAM,
) -> DataFrame:
    """One row per row: its id, n_links, component_id, kept, and the audited recall of the search.

    Vectors are compared within a label and a dimension. Null labels, null or zero vectors and
    vectors with a null or non-finite component link with nothing. Rows with equal vectors of a
    label link with each other. component_id is the smallest id that links lead to; kept says
    whether it is the row's own. A null id never names a component with other ids; a row whose
    component has no id keeps null and is kept. An empty table gives no rows.
    """
    rows = numbered(
        settled(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))), "row"
    )
    members, nodes = nodes_of(rows, "label", "v")
    shards = shards_of(nodes)
    graph = build(shards)
    while True:
        pairs = stage(range_pairs(nodes, shards, graph, cosine, beam), "vector_pairs")
        recall = audited_recall(nodes, pairs, cosine)
        if recall >= RECALL or beam >= 8 * BEAM:
            break
        beam *= 2
    sizes = nodes.select("node", "copies")
    links = pairs.union(pairs.select("b", "a")).join(sizes.withColumnRenamed("node", "b"), "b")
    links = links.groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "node")
    roots = components(pairs)
    placed = sizes.join(links, "node", "left").join(roots, "node", "left")
    placed = placed.select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    full = stage(rows.select("row", "id").join(members, "row", "left").join(placed, "node", "left"), "placed_vectors")
    lowest = full.filter("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    out = full.join(lowest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.lit(recall).alias("audited_recall"),
    )
