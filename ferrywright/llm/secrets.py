"""Secrets in texts: known patterns, and strings that a tokenizer's vocabulary cannot shorten.

Ordinary words and names fall into few tokens of a vocabulary that was made from real
text, random strings into many. A string of key characters with few characters per token
is reported, unless it is a known digest or identifier.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# A string is random when it has fewer characters per token than this.
MOST_CHARS_PER_TOKEN = 2.1
# Letters of one case may be a word of a language that the vocabulary hardly knows, so they need more tokens.
MOST_CHARS_PER_TOKEN_OF_LETTERS = 1.7
LEAST_LENGTH = 16
# Fewer letters among digits are dates and numbers with units.
LEAST_LETTERS = 4
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_STRING = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_LENGTH)
_SEGMENT = re.compile(r"[A-Za-z0-9+]{%d,}={0,2}" % LEAST_LENGTH)
_PARTS = re.compile(r"[+/_=-]+")
_WORDLIKE = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+|[+/_=-]+")
# Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and UUIDs are no secrets, nor are digests
# with the name of their function, as web pages give them for the files they load.
_DIGEST = re.compile(r"(?:0x)?(?:[0-9a-f]+|[0-9A-F]+)")
_NAMED_DIGEST = re.compile(r"sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)")
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PATTERN = (
    r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+"""
)


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _is_known(string: str) -> bool:
    return bool(
        (len(string.removeprefix("0x")) in _DIGEST_LENGTHS and _DIGEST.fullmatch(string))
        or _NAMED_DIGEST.fullmatch(string)
        or _IDENTIFIER.fullmatch(string)
        or _WORDLIKE.fullmatch(string)
    )


def chars_per_token(string: str, path: str = VOCABULARY) -> float:
    return len(string) / len(_encoding(path).encode_ordinary(string))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known patterns."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES) or not low.isascii():
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=_place)


def _looks_random(string: str, path: str) -> bool:
    """Whether a string is no known one, has letters enough, and many tokens; letters of one case need more of them."""
    if string.isalpha() and _WORDLIKE.fullmatch(string):
        return chars_per_token(string, path) < MOST_CHARS_PER_TOKEN_OF_LETTERS
    if _is_known(string) or sum(c.isalpha() for c in string) < LEAST_LETTERS:
        return False
    if not any(c.isdigit() for c in string):
        # Words and names joined by separators have many tokens too; each of them is tested by itself.
        if string.islower() or string.isupper() or all(_WORDLIKE.fullmatch(part) for part in _PARTS.split(string)):
            return False
    return chars_per_token(string, path) < MOST_CHARS_PER_TOKEN


def random_spans(text: str, path: str = VOCABULARY) -> list[tuple[int, str, int]]:
    """(start, kind, end) of strings that look random to the vocabulary."""
    found = []
    for m in _STRING.finditer(text):
        string = m.group()
        if _looks_random(string, path):
            found.append((m.start(), "random", m.end()))
        elif not _is_known(string):
            # Words around a secret hide it in the whole.
            parts = (s for s in _SEGMENT.finditer(string) if s.end() - s.start() < len(string))
            found += [(m.start() + s.start(), "random", m.start() + s.end()) for s in parts if _looks_random(s.group(), path)]
    return found


def _place(span: tuple[int, str, int]):
    return span[0], KINDS.index(span[1])


def _join(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of `docs`: its id, counts by kind, a digest of the base spans, and all spans.

    Spans are kind:start:end in code points, by start and then kind. A null text is empty
    and has none; rows that repeat get equal results; an empty table gives no rows.
    """
    small_batches(docs)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                body = value.as_py() or ""
                base = base_spans(body)
                more = random_spans(body, vocabulary)
                counts = [sum(s[1] == k for s in base) for k in KINDS[:3]] + [len(more)]
                digest = hashlib.sha256(_join(base).encode()).hexdigest()
                rows.append((*counts, digest, _join(sorted(base + more, key=_place))))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *names])

    return narrow.mapInArrow(run, f"id {kind}, {_SCHEMA}").withColumnRenamed("id", id_col)
