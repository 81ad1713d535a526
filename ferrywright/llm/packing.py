"""Conflict-constrained best-fit packing of documents into sequences of bounded length.

A document goes into the tightest bin that has room for it and no conflict: a bin takes
no two pieces of a cluster of duplicates and only so many pieces of one source. Bins are
kept by their residual and carry bitmaps of their sources and clusters; the search goes
from the tightest residual upwards until a compatible bin is found.

The pieces are dealt at random into shards of bounded size, each packed by one task. A
shard gains nothing from seeing the others but the room in its last open bins.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywright.llm import near_copies
from ferrywright.llm.common import fresh, numbered, settled, words_of
from ferrywright.session import stage

CAPACITY = 2048
# Pieces of one source that a bin may hold.
SOURCE_LIMIT = 2
# Mean number of pieces that one task packs.
SHARD = 4096


class Bins:
    """The bins of a shard, by residual."""

    def __init__(self, capacity: int, source_limit: int):
        self.capacity, self.source_limit = capacity, source_limit
        self.residual: list[int] = []
        # A bitmap of sources for each piece of a source that a bin may hold, filled in order.
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.levels: dict[int, list[int]] = defaultdict(list)
        self.occupied = 0

    def _successor(self, residual: int) -> int | None:
        """The smallest residual of a bin that is not below this one."""
        above = self.occupied >> residual
        return residual + (above & -above).bit_length() - 1 if above else None

    def _find(self, length: int, source: int, cluster: int) -> int | None:
        residual = self._successor(length)
        while residual is not None:
            for b in self.levels[residual]:
                if not (self.sources[b][-1] & source or self.clusters[b] & cluster):
                    return b
            residual = self._successor(residual + 1)
        return None

    def _move(self, b: int, residual: int) -> None:
        old = self.residual[b]
        self.levels[old].remove(b)
        if not self.levels[old]:
            self.occupied &= ~(1 << old)
        self._enter(b, residual)

    def _enter(self, b: int, residual: int) -> None:
        self.residual[b] = residual
        self.levels[residual].append(b)
        self.occupied |= 1 << residual

    def add(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) for a piece; source and cluster have at most one bit."""
        b = self._find(length, source, cluster)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append([0] * self.source_limit)
            self.clusters.append(0)
            self._enter(b, self.capacity)
        start = self.capacity - self.residual[b]
        self._move(b, self.residual[b] - length)
        for k, plane in enumerate(self.sources[b]):
            if not plane & source:
                self.sources[b][k] |= source
                break
        self.clusters[b] |= cluster
        return b, start


def pack_shard(lengths, sources, clusters, capacity: int, source_limit: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece; the longest are placed first, equal ones in their order.

    Sources and clusters that are None conflict with nothing.
    """
    members = Counter(c for c in clusters if c is not None)
    bins, out = Bins(capacity, source_limit), [(0, 0)] * len(lengths)
    shared = {c: 1 << k for k, c in enumerate(c for c, n in members.items() if n > 1)}
    known = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = bins.add(lengths[i], known.get(sources[i], 0), shared.get(clusters[i], 0))
    return out


def duplicate_cluster(text: Column) -> Column:
    """A text's cluster of duplicates: texts that differ in case and white space at most."""
    return F.xxhash64(F.lower(F.array_join(words_of(text), " ")))


def pack(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", capacity: int = CAPACITY,
    source_limit: int = SOURCE_LIMIT, cluster: Column | None = None, shard: int = SHARD,
) -> DataFrame:
    """A row per piece of a document: id, piece, first_word, n_words, bin_id and start in the bin.

    Documents longer than a bin are cut into pieces of a bin's length and a rest. Lengths
    are words. `cluster` tells duplicates by equal values, by default the texts themselves.
    Null sources and clusters conflict with nothing. A document without words, or with a
    null text, has one row whose bin and start are null. Repeated rows are duplicates of each
    other. Null ids are carried like others. An empty table gives no rows.
    """
    docs = settled(docs)
    body = F.col(text).cast("string")
    rows = numbered(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source).cast("string").alias("source"),
            F.size(words_of(body)).cast("long").alias("length"),
            (duplicate_cluster(body) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
        ),
        "row",
    )
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0).cast("long")))
    pieces = rows.withColumn("piece", F.explode(cuts))
    pieces = pieces.withColumn("first_word", F.col("piece") * capacity)
    pieces = stage(
        pieces.withColumn("n_words", F.least(F.col("length") - F.col("first_word"), F.lit(capacity))).drop("length"),
        "pieces",
    )
    shards = max(1, math.ceil(pieces.filter("n_words > 0").count() / shard))
    full = pieces.filter("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        columns = [table.column(c).to_pylist() for c in ("n_words", "source", "cluster")]
        placed = pack_shard(*columns, capacity, source_limit)
        first = table.column("shard")[0].as_py() << 32
        return pa.table(
            {
                **{c: table.column(c) for c in ("id", "piece", "first_word", "n_words")},
                "bin_id": pa.array([first + b for b, _ in placed], pa.int64()),
                "start": pa.array([s for _, s in placed], pa.int64()),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece long, first_word long, n_words long, bin_id long, start long"
    packed = full.groupBy("shard").applyInArrow(run, schema)
    nothing = F.lit(None).cast("long")
    empty = pieces.filter("n_words = 0").select("id", "piece", "first_word", "n_words", nothing.alias("bin_id"), nothing.alias("start"))
    return packed.union(empty).withColumnRenamed("id", id_col)


def pack_apart(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **limits) -> DataFrame:
    """`pack`, with the groups of verified near copies among all documents as clusters."""
    docs = settled(docs.select(id_col, source, text))
    row, root = fresh(docs, "_row", "_root")
    rows = numbered(docs, row)
    found = near_copies.groups(rows.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text")))
    placed = rows.join(found.select(F.col("row").alias(row), F.col("root").alias(root)), row)
    return pack(placed, id_col, source, text, cluster=F.col(root), **limits)
