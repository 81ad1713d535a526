"""Hashes of the word runs of texts, and how rare they are, in Arrow batches inside tasks.

A word's hash is a polynomial of its bytes modulo 2**64, mixed; all words of a batch are
hashed at once from sums over its bytes. A run's hash is one of its words' hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import small_batches

SHINGLE = 5
# Two counters of a shingle, of so many each; its rarity is that of the lesser.
COUNTERS = 1 << 21
BLOCK = 1 << 14
# Bytes that are hashed at a time, but for longer words; shingles that are counted at a time.
CHUNK = 1 << 20
# Longs of a text's parity bitmap, and of the shorter one that travels with rare shingles.
PARITY = 16
SHORT_PARITY = 8

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(n, base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin, and their hashes; the last byte is white space."""
    starts, hashes, a = [], [], 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        while not _SPACE[data[b - 1]]:
            ahead = _SPACE[data[b - 1 : b + 4095]]
            b += int(ahead.argmax()) if ahead.any() else len(ahead)
        part = data[a:b]
        inside = np.zeros(len(part) + 1, np.int8)
        inside[1:] = ~_SPACE[part]
        steps = np.diff(inside)
        first, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _powers(_BASE, len(part)), out=sums[1:])
        inverse = _powers(pow(_BASE, -1, 1 << 64), len(part))
        starts.append(first + a)
        hashes.append(_mixed((sums[end] - sums[first]) * inverse[first]))
        a = b
    return np.concatenate(starts), np.concatenate(hashes)


def _runs(texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes of all runs of a batch, and where those of each text are; texts end in a line break.

    A text of fewer words than a run has is one run, without words none.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    starts, words = _word_hashes(np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]])
    ends = np.searchsorted(starts, at - at[0])
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs = runs * _U(_BASE) + words[k : k + n]
    runs, short, where = _mixed(runs), [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= SHINGLE:
            where.append((a, b - SHINGLE + 1))
        elif b > a:
            where.append((n + len(short), n + len(short) + 1))
            short.append(hash_of_few(words[a:b].tolist()))
        else:
            where.append((0, 0))
    return np.concatenate([runs, np.array(short, np.uint64)]), where


def hash_of_few(words: list[int]) -> int:
    out = len(words)
    for w in words:
        out = (out * _BASE + w) % (1 << 64)
    return int(_mixed(np.array([out], np.uint64))[0])


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of each text, one text after the other, and the places between texts."""
    runs, where = _runs(texts)
    sets = [np.unique(runs[a:b]) for a, b in where]
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _input(rows: DataFrame, text: str, *more: str) -> DataFrame:
    small_batches(rows)
    body: Column = F.concat(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit("\n"))
    return rows.select(*more, body.alias("text"))


def _counters(runs: np.ndarray) -> list[np.ndarray]:
    bits = COUNTERS.bit_length() - 1
    return [(runs >> _U(64 - bits * (k + 1)) & _U(COUNTERS - 1)).astype(np.int64) for k in range(2)]


def rarity(rows: DataFrame, text: str = "text") -> Broadcast:
    """The class of rarity of each counter of all runs, of fixed size whatever the input; 0 is rare.

    A run that a text repeats counts again. Classes make an order of shingles, and any order gives the same result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = np.zeros(2 * COUNTERS, np.uint32), []

        def add() -> None:
            for k, found in enumerate(_counters(np.concatenate(waiting))):
                total[k * COUNTERS : (k + 1) * COUNTERS] += np.bincount(found, minlength=COUNTERS).astype(np.uint32)
            waiting.clear()

        for batch in batches:
            if batch.num_rows:
                waiting.append(_runs(batch.column(0))[0])
            if sum(map(len, waiting)) >= 2 * CHUNK:
                add()
        if waiting:
            add()
        for block in np.flatnonzero(total.reshape(-1, BLOCK).any(axis=1)).tolist():
            part = np.minimum(total[block * BLOCK : (block + 1) * BLOCK], 0xFFFF)
            packed = zlib.compress((part & 0xFF).astype(np.uint8).tobytes() + (part >> 8).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for packed in table.column("counts"):
            part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8).astype(np.int64)
            total += part[:BLOCK] + (part[BLOCK:] << 8)
        # Shingles are dealt to counters by hash, so every block has the same usual load.
        usual = np.median(total)
        above = np.maximum((total - usual) / (4 * np.sqrt(usual) + 4), 0.5)
        classes = np.where(above <= 1, 0, np.minimum(1 + 4 * np.log2(above), 127)).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1], "classes": pa.array([classes.tobytes()], pa.binary())})

    counts = _input(rows, text).mapInArrow(count, "block int, counts binary")
    found = counts.groupBy("block").applyInArrow(merge, "block int, classes binary").collect()
    classes = np.zeros(2 * COUNTERS, np.uint8)
    for r in found:  # at most 2 * COUNTERS bytes
        classes[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.classes, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(classes.tobytes())


def prefix_size(n: int, t: float) -> int:
    """How many of the rarest of n shingles similar sets must share one of."""
    return n - int(np.ceil(t * n - 1e-9)) + 1


def _sum_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number per text that is the same for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _parity(found: np.ndarray, at: np.ndarray, longs: int) -> list[pa.Array]:
    """The parity bitmaps of the sets, a column for each long."""
    bits, n = 64 * longs, len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    odd = np.bincount(of * bits + (found & _U(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    maps = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, longs)
    return [pa.array(maps[:, k].copy()) for k in range(longs)]


def parity_names(longs: int) -> list[str]:
    return [f"p{k}" for k in range(longs)]


def sets(rows: DataFrame, classes: Broadcast, t: float, row: str = "row", text: str = "text") -> DataFrame:
    """Columns row, n, set, set2 (equal for equal sets), prefix, the keys of the rarest shingles in order, and a short
    parity bitmap."""
    maps = parity_names(SHORT_PARITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, at = _sets(batch.column(1))
            first, second = _counters(found)
            rare = np.minimum(known[first], known[COUNTERS + second]).astype(np.uint64)
            keys = (rare << _U(56)) | (found & _U((1 << 56) - 1))
            prefixes = [np.sort(keys[a:b])[: prefix_size(b - a, t)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            ends = np.cumsum([0, *map(len, prefixes)])
            twice = [_sum_of(_mixed(found + _U(k)), at) for k in (1, _BASE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at), pa.int32()), *map(pa.array, twice), _lists(np.concatenate(prefixes), ends),
                 *_parity(found, at, SHORT_PARITY)],
                ["row", "n", "set", "set2", "prefix", *maps],
            )

    schema = "row long, n int, set long, set2 long, prefix array<long>, " + ", ".join(f"{m} long" for m in maps)
    return _input(rows, text, row).mapInArrow(run, schema)


def whole(rows: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """Columns row, n, shingles and p0, p1 and so on, the parity bitmap of the shingles."""
    maps = parity_names(PARITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, at = _sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at), pa.int32()), _lists(found, at), *_parity(found, at, PARITY)],
                ["row", "n", "shingles", *maps],
            )

    schema = "row long, n int, shingles array<long>, " + ", ".join(f"{m} long" for m in maps)
    return _input(rows, text, row).mapInArrow(run, schema)
