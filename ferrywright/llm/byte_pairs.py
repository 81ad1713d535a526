"""Byte-level BPE: texts to the ids of a rank file, and ids back to bytes.

A pattern cuts a text into pre-tokens, whose bytes are then merged by rank. Where a match
ends depends on the text from its first character on, so two readings of a text that have
one boundary in common agree from there on. Long texts are therefore cut into chunks that
overlap, the chunks are pre-tokenised side by side in different tasks, neighbours are
stitched at the first boundary that both have in their overlap, and the pre-tokens between
the stitches are encoded. Neighbours without a common boundary (one run of letters over the
whole overlap) are read again as one chunk, from the last boundary that is certain.
"""

from __future__ import annotations

import base64
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.llm.common import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
# Code points of a chunk, and those that it shares with the next one.
CHUNK = 32_768
OVERLAP = 1_024
# How far behind its end a match of the pattern may look ('re and 've need two characters).
LOOKAHEAD = 2
# Pre-tokens whose ids a task remembers.
_REMEMBER = 400_000
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@dataclass
class Vocabulary:
    """What the tasks need; sent to them once."""

    ranks: dict[bytes, int]
    plain: str  # the pattern as it is
    exact: str  # the same with the tokenizer's own character classes
    odd: str  # the characters that the two tell differently


def _ranges(characters: set[str]) -> str:
    codes = sorted(map(ord, characters))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def load(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file, read by the driver.

    The pattern is matched by another library than the tokenizer's, which may know an older
    or newer Unicode; the classes of characters are taken from the tokenizer's answers.
    """
    import regex
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path(RANKS)
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    exact, odd = pattern, set()
    for name in _CLASSES:
        own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ranks, special_tokens={})
        theirs = set(own.decode_bytes(own.encode_ordinary(everything)).decode())
        ours = set(regex.findall(name, everything))
        odd |= theirs ^ ours
        if ours - theirs:
            exact = exact.replace(name, f"[{name}--[{_ranges(ours - theirs)}]]")
        if theirs - ours:
            exact = exact.replace(name, f"[{name}||[{_ranges(theirs - ours)}]]")
    return Vocabulary(ranks, pattern, f"(?V1){exact}", _ranges(odd))


class Splitter:
    """The pre-tokens of texts."""

    def __init__(self, v: Vocabulary):
        import regex

        self.plain, self.exact = regex.compile(v.plain), regex.compile(v.exact)
        # Most texts lie below the first odd character; one range is searched fastest.
        self.may_be_odd = re.compile(f"[{v.odd[:10]}-\\U0010ffff]") if v.odd else None
        self.odd = regex.compile(f"[{v.odd}]") if v.odd else None

    def split(self, text: str) -> list[str]:
        odd = self.odd and self.may_be_odd.search(text) and self.odd.search(text)
        found = (self.exact if odd else self.plain).findall(text)
        if len("".join(found)) != len(text):
            raise ValueError("the pattern must match every character of a text")
        return found

    def certain(self, text: str, last: bool) -> list[int]:
        """Where pre-tokens start and, at the end of the list, how far they are certain."""
        places = [0, *itertools.accumulate(map(len, self.split(text)))]
        while not last and len(places) > 1 and places[-1] + LOOKAHEAD > len(text):
            places.pop()
        return places


class Merger(dict):
    """The ids of pre-tokens as bytes of 32-bit numbers; those met before are remembered."""

    def __init__(self, v: Vocabulary):
        import tiktoken

        # Every text is one pre-token for this encoding.
        self.one = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=v.ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _REMEMBER:
            self.clear()
        found = self[piece] = np.array(self.one.encode_ordinary(piece), np.int32).tobytes()
        return found

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


class Stitcher:
    """Puts the chunks of one text together, which come in their order."""

    def __init__(self, splitter: Splitter, merger: Merger):
        self.splitter, self.merger = splitter, merger
        self.text, self.start, self.places, self.at, self.ids = "", 0, [0], 0, []
        self.read = 0  # how long the held text was when no boundary was found in it

    def _emit(self, until: int) -> None:
        """Encode the pre-tokens of the held chunk from the last stitch to this place of the text."""
        own = [x for x in self.places if self.at <= x + self.start <= until]
        self.ids.append(self.merger.ids([self.text[a:b] for a, b in itertools.pairwise(own)]))
        self.at = until

    def add(self, text: str, start: int, places: list[int], last: bool) -> None:
        """`places` as from `Splitter.certain`; start and places count code points."""
        if not start:
            self.text, self.start, self.places = text, start, places
        else:
            held = {x + self.start for x in self.places if x + self.start >= max(self.at, start)}
            common = next((x + start for x in places if x + start in held), None)
            if common is not None:
                self._emit(common)
                self.text, self.start, self.places, self.read = text, start, places, 0
            else:
                # What is certain so far is encoded; the rest and this chunk are one chunk.
                self._emit(self.places[-1] + self.start)
                rest = self.text[self.at - self.start :] + text[self.start + len(self.text) - start :]
                # It is read again when it has doubled, so that a very long run is not read for each chunk of it.
                again = last or len(rest) >= 2 * self.read
                self.text, self.start = rest, self.at
                self.places = self.splitter.certain(rest, last) if again else [0]
                self.read = 0 if len(self.places) > 1 else len(rest) if again else self.read
        if last:
            self._emit(self.places[-1] + self.start)


def _pretokenised(chunks: DataFrame, shared) -> DataFrame:
    """`chunks` with the sizes of the certain pre-tokens of each."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def run(batches):
        splitter = Splitter(shared.value)
        for batch in batches:
            sizes = []
            for text, last in zip(batch.column("piece").to_pylist(), batch.column("last").to_pylist()):
                places = splitter.certain(text, last)
                sizes.append([b - a for a, b in itertools.pairwise(places)])
            columns = [*batch.columns, pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sizes"])

    return chunks.mapInArrow(run, schema)


def _encode_long(texts: DataFrame, shared, schema: T.StructType, chunk: int, overlap: int) -> DataFrame:
    """Ids of texts of several chunks. Repeated rows are cut once and counted."""
    step = chunk - overlap
    # The last chunk is more than an overlap long, unless it is the only one.
    count = F.ceil((F.char_length("body") - overlap) / F.lit(step)).cast("int")
    chunks = (
        texts.select("id", F.sha2("body", 256).alias("digest"), "body", count.alias("count"))
        .select("id", "digest", "body", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("no"))
        .select(
            "id", "digest", "no", (F.col("no") == F.col("count") - 1).alias("last"),
            F.substring("body", F.col("no") * step + 1, F.lit(chunk)).alias("piece"),
        )
    )
    # The chunks of a text are dealt out over the tasks by their number, then come together by text.
    dealt = chunks.groupBy("id", "digest", "no", "last", "piece").agg(F.count("*").alias("copies"))
    ordered = _pretokenised(dealt, shared).repartition("id", "digest").sortWithinPartitions("id", "digest", "no")

    def run(batches):
        splitter, merger = Splitter(shared.value), Merger(shared.value)
        stitcher = None
        for batch in batches:
            rows, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("no", "last", "piece", "copies", "sizes"))
            for row, (no, last, piece, copies, sizes) in enumerate(zip(*columns)):
                if not no:
                    stitcher = Stitcher(splitter, merger)
                stitcher.add(piece, no * step, [0, *itertools.accumulate(sizes)], last)
                if last:
                    rows += [row] * copies
                    out += [b"".join(stitcher.ids)] * copies
            yield _encoded(batch.column("id").take(pa.array(rows, pa.int64())), out)

    return ordered.mapInArrow(run, schema)


def _encoded(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    return pa.RecordBatch.from_arrays([keys, pa.array(sizes), lists], ["id", "n_tokens", "ids"])


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per row of `docs`: id, n_tokens and ids of the whole text, without special tokens.

    A null or empty text has no ids; repeated rows are encoded once per row; a null id is
    kept; other columns take no part; an empty table gives no rows. A text of up to `chunk`
    code points is one chunk and stays in the task that reads it.
    """
    if not LOOKAHEAD < overlap < chunk:
        raise ValueError("chunks must be longer than their overlap")
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(load(path, pattern))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches):
        splitter, merger = Splitter(shared.value), Merger(shared.value)
        for batch in batches:
            texts = batch.column("body").to_pylist()
            yield _encoded(batch.column("id"), [merger.ids(splitter.split(t)) for t in texts])

    short = narrow.filter(F.char_length("body") <= chunk).mapInArrow(run, schema)
    long = _encode_long(narrow.filter(F.char_length("body") > chunk), shared, schema, chunk, overlap)
    return short.union(long).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """`rows` with the bytes of their ids, one after the other.

    Null ids give null; a null or unknown id among them gives nothing. Bytes of single ids
    need not be whole characters, so the result is binary.
    """
    small_batches(rows)
    ranks = load(path).ranks
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType([f for f in rows.schema.fields if f.name.lower() != name.lower()])
    kept = schema.names
    schema = T.StructType([*schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        pieces = shared.value
        for batch in batches:
            lists = batch.column(ids)
            out = []
            for i in range(len(lists)):
                own = lists[i].values
                if own is not None:
                    own = own.drop_null().to_numpy()
                    own = own[(own >= 0) & (own < len(pieces))].tolist()
                out.append(None if own is None else b"".join(map(pieces.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids as decimal text and of the bytes they decode to."""
    found = decode(encode(docs, id_col, text))
    return found.select(
        id_col,
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
