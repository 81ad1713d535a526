"""Encoding to and decoding from the pieces of a SentencePiece model by the unigram method.

A text's segmentation is the one with the largest sum of piece scores, found by Viterbi's
algorithm. The scores in the file are the ranks of merges, no probabilities, so the log
probabilities of the pieces are estimated from all documents, by counting the pieces of
the best segmentation and segmenting anew. Pieces are looked up in a double-array trie over UTF-8 bytes: from a state s
the byte c leads to base[s] + c if check there is s. The model's marker of white space
stands for a space; a character without a piece falls back to pieces of its bytes.

No piece has a space behind another character, so a text is segmented between words, and
each distinct word of a batch only once, all words of about one length together.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import small_batches
from ferrywright.session import discard, stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
# What a character without a piece costs below the lowest score.
UNKNOWN = 10.0
# Rounds of counting, and what is added to each count.
ROUNDS = 3
SMOOTHING = 0.5
# Words whose pieces a task remembers, and words segmented at once.
_REMEMBER = 800_000
_AT_ONCE = 32_768
_WORD = re.compile(r" *[^ ]+| +$")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Pieces:
    """A vocabulary as arrays that are sent to the tasks."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # of a state, the piece that ends there, or -1
    score: np.ndarray  # of a piece
    unknown: float
    byte_piece: np.ndarray  # of a byte, its piece
    surface: list[bytes]  # of a piece, what it decodes to
    longest: int
    by_word: bool


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie of sorted, distinct keys; state 0 is the root."""
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free_from = 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(keys[lo][0]) == depth:
            value[state] = keys[lo][1]
            lo += 1
        children = []
        while lo < hi:
            byte, end = keys[lo][0][depth], lo + 1
            while end < hi and keys[end][0][depth] == byte:
                end += 1
            children.append((byte, lo, end))
            lo = end
        if not children:
            continue
        codes = np.array([c for c, _, _ in children])
        while check[free_from] >= 0:
            free_from += 1
        window = free_from
        while True:
            if window + 8192 >= len(check):
                more = len(check)
                base, value = np.append(base, np.zeros(more, np.int32)), np.append(value, np.full(more, -1, np.int32))
                check = np.append(check, np.full(more, -1, np.int32))
            # The first place where all children are free.
            starts = np.flatnonzero(check[window : window + 4096] < 0) + window - codes[0]
            starts = starts[starts > 0]
            fits = starts[(check[starts[:, None] + codes] < 0).all(axis=1)]
            if len(fits):
                start = int(fits[0])
                break
            window += 4096
        base[state] = start
        check[start + codes] = state
        todo += [(start + c, a, b, depth + 1) for c, a, b in children]
    return base, check, value


def load(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file; control, unknown and unused pieces take no part."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keys, surface, bytes_of = [], [], np.full(256, -1, np.int32)
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(_BYTE.fullmatch(text)[1], 16)
            bytes_of[value] = i
            surface.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            plain = text.replace(MARKER, " ").encode()
            keys.append((plain, i))
            surface.append(plain)
    if (bytes_of < 0).any():
        raise ValueError("the model has no piece for some bytes")
    base, check, value = double_array(sorted(keys))
    scores = np.array([model.get_score(i) for i in range(len(surface))], np.float64)
    lowest = scores[[i for _, i in keys]].min()
    by_word = not any(re.search(rb"[^ ] ", k) for k, _ in keys)
    return Pieces(base, check, value, scores, lowest - UNKNOWN, bytes_of, surface, max(len(k) for k, _ in keys), by_word)


def segment(words: list[bytes], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the pieces of all words after each other, and how many each word has.

    Words are segmented side by side. Of equally good segmentations the one whose last piece
    is longest is taken, and so on towards the front.
    """
    count, width = len(words), max(map(len, words))
    text = np.zeros((count, width + 1), np.uint8)
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    text[np.arange(width + 1) < lengths[:, None]] = flat
    char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
    begins = (text & 0xC0) != 0x80
    best = np.full((count, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((count, width + 1), np.int32)
    took = np.full((count, width + 1), -1, np.int32)
    for i in range(width):
        at = np.flatnonzero(begins[:, i] & (lengths > i))
        if not len(at):
            continue
        score, size = best[at, i], char[at, i]
        single = np.zeros(len(at), bool)
        live, state = np.arange(len(at)), np.zeros(len(at), np.int64)
        for j in range(i, min(width, i + p.longest)):
            rows = at[live]
            to = p.base[state] + text[rows, j]
            good = (p.check[to] == state) & (lengths[rows] > j) & (to > 0)
            live, state = live[good], to[good]
            if not len(live):
                break
            piece = p.piece[state]
            ends = np.flatnonzero(piece >= 0)
            if not len(ends):
                continue
            k, piece = live[ends], piece[ends]
            single[k] |= size[k] == j + 1 - i
            total = score[k] + p.score[piece]
            better = total > best[at[k], j + 1]
            rows, piece = at[k[better]], piece[better]
            best[rows, j + 1], back[rows, j + 1], took[rows, j + 1] = total[better], i, piece
        k = np.flatnonzero(~single)
        rows, end, total = at[k], i + size[k], score[k] + p.unknown
        better = total > best[rows, end]
        rows, end = rows[better], end[better]
        best[rows, end], back[rows, end], took[rows, end] = total[better], i, -1
    # All words are walked back together; a piece is put where it begins, so that they end up in order.
    chosen = np.full((count, width + 1), -1, np.int32)
    rows, end = np.flatnonzero(lengths), lengths[lengths > 0]
    while len(rows):
        start, piece = back[rows, end], took[rows, end]
        found = piece >= 0
        chosen[rows[found], start[found]] = piece[found]
        lost, first, size = rows[~found], start[~found], (end - start)[~found]
        for k in range(4):
            lost, first, size = lost[size > k], first[size > k], size[size > k]
            chosen[lost, first + k] = p.byte_piece[text[lost, first + k]]
        rows, end = rows[start > 0], start[start > 0]
    taken = chosen >= 0
    return chosen[taken], taken.sum(axis=1)


class Known:
    """Pieces of the words that a task has met: a place per word, and the ids of all places after each other."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.count = np.array([], np.int32), np.array([], np.int64)
        self.start = self.count

    def learn(self, new: list[str], p: Pieces) -> None:
        """Add new words, which are in the order of their lengths."""
        ids, counts = [self.ids], [self.count]
        for part, found, count in _segmented(new, p):
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            ids.append(found)
            counts.append(count)
        self.ids, self.count = np.concatenate(ids), np.concatenate(counts)
        self.start = np.cumsum(self.count) - self.count

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of known words after each other."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        return self.ids[np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())], count


def encode_texts(texts: list[str], p: Pieces, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the pieces of all texts after each other and where each text's begin; `known` remembers words."""
    split = [_WORD.findall(" " + t) if p.by_word else [" " + t] for t in texts]
    words = list(itertools.chain.from_iterable(split))
    different = set(words)
    new = sorted((w for w in different if w not in known.place), key=len)
    if new and len(known.place) + len(new) > _REMEMBER:
        known.__init__()
        new = sorted(different, key=len)
    if new:
        known.learn(new, p)
    ids, count = known.pieces(words)
    ends = np.concatenate([[0], np.cumsum(count)])
    return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]


def _segmented(new: list[str], p: Pieces):
    """(words, ids, lengths) for parts of the words, which are in the order of their lengths."""
    start = 0
    while start < len(new):
        # Side by side only as many as their longest allows.
        step = max(1, min(_AT_ONCE, 4_000_000 // (4 * len(new[min(start + _AT_ONCE, len(new)) - 1]) + 1)))
        part = new[start : start + step]
        yield part, *segment([w.encode("utf-8", "replace") for w in part], p)
        start += step


def scored(p: Pieces, counts: np.ndarray) -> Pieces:
    """`p` with the smoothed log probabilities of the counts of its pieces."""
    took_part = np.zeros(len(p.surface), bool)
    took_part[p.piece[p.piece >= 0]] = True
    n = counts[took_part] + SMOOTHING
    scores = np.zeros(len(p.surface))
    scores[took_part] = np.log(n / n.sum())
    return replace(p, score=scores, unknown=float(scores.min()) - UNKNOWN)


def _counts(words: DataFrame, p: Pieces) -> np.ndarray:
    """How often each piece is in the best segmentations of the words (word, n)."""
    shared = words.sparkSession.sparkContext.broadcast(p)
    # Words are short; batches are also bounded in bytes.
    words.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")

    def run(batches):
        p = shared.value
        counts, some, size = np.zeros(len(p.surface), np.int64), {}, 0

        def add():
            # Floats would lose counts above 2^53, so the sums of a block are added as whole numbers.
            for part, ids, lengths in _segmented(sorted(some, key=len), p):
                times = np.repeat(np.fromiter(map(some.__getitem__, part), np.int64, len(part)), lengths)
                counts[:] += np.rint(np.bincount(ids, times, len(counts))).astype(np.int64)

        for batch in batches:
            some.update(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            size += batch.column("word").nbytes
            if len(some) >= _AT_ONCE or size > 1_000_000:
                add()
                some, size = {}, 0
        if some:
            add()
        # Pieces of bytes are chosen by need, not by their score.
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["piece", "n"])

    sums = words.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    out = np.zeros(len(p.surface), np.int64)
    for piece, n in sums.collect():  # at most one row per piece
        out[piece] = n
    return out


def estimate(docs: DataFrame, p: Pieces, text: str = "text", rounds: int = ROUNDS) -> Pieces:
    """`p` with log probabilities of its pieces in all documents, from equal ones on.

    Only the different words and their counts, reduced before the shuffle, are segmented.
    """
    body = F.concat(F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit("")))
    parts = F.regexp_extract_all(body, F.lit(_WORD.pattern), F.lit(0)) if p.by_word else F.array(body)
    words = stage(docs.select(F.explode(parts).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    p = scored(p, np.zeros(len(p.surface)))
    for _ in range(rounds):
        p = scored(p, _counts(words, p))
    discard(words)
    return p


def _plain(joined: bytes) -> str:
    """The text of joined pieces: without the space in front that encoding puts there."""
    return joined.decode("utf-8", "replace").removeprefix(" ")


def decode_ids(ids, p: Pieces) -> str:
    """The text of pieces."""
    return _plain(b"".join(map(p.surface.__getitem__, ids)))


def _joined(surfaces: pa.LargeBinaryArray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of all pieces of each text; Arrow has put them after each other already."""
    if not len(surfaces):
        return [b""] * (len(offsets) - 1)
    ends = np.frombuffer(surfaces.buffers()[1], np.int64)[offsets]
    data = surfaces.buffers()[2]
    return [data[a:b].to_pybytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Per row of `docs`: id, n_pieces, n_bytes (pieces of single bytes), ids, and whether decoding gives the text.

    A null text is empty; an empty text has the piece of the space in front. Repeated rows
    get equal results; an empty table gives no rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(estimate(docs, load(model), text))
    small_batches(docs)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        p, known = vocabulary.value, Known()
        surfaces = pa.array(p.surface, pa.large_binary())
        is_byte = np.zeros(len(p.surface), bool)
        is_byte[p.byte_piece] = True
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            flat, offsets = encode_texts(texts, p, known)
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[flat])])
            decoded = _joined(surfaces.take(pa.array(flat, pa.int32())), offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(np.diff(bytes_before[offsets]), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([_plain(x) == t for x, t in zip(decoded, texts)], pa.bool_()),
                ],
                ["id", "n_pieces", "n_bytes", "ids", "round_trip"],
            )

    schema = f"id {kind}, n_pieces long, n_bytes long, ids array<int>, round_trip boolean"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """`rows` with the texts of their pieces; null for null ids, and pieces that do not exist give nothing."""
    small_batches(rows)
    vocabulary = rows.sparkSession.sparkContext.broadcast(load(model))
    schema = rows.withColumn(name, F.lit("")).schema

    def run(batches):
        p = vocabulary.value
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            valid = ([i for i in x if i is not None and 0 <= i < len(p.surface)] if x is not None else None for x in lists)
            texts = pa.array([None if x is None else decode_ids(x, p) for x in valid], pa.string())
            columns = {c: batch.column(c) for c in batch.schema.names} | {name: texts}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, schema)
