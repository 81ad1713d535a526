"""Byte-level BPE against the tokenizer's own library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ferrywright.llm import byte_pairs

SCHEMA = "doc_id long, text string, ids string, decoded int, id int, body string"


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    import tiktoken

    v = byte_pairs.load()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def numbers(stitcher):
    return np.frombuffer(b"".join(stitcher.ids), np.int32).tolist()


def texts():
    rng = random.Random(7)
    parts = ["word", " and", "  ", "\n\n", " 's", "'re", "'", "’ve", " 12", "345", "é", "漢字", " 😀", "\t", "...", " x" * 9, "\x1c", "ǅ"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    new = "".join(chr(c) for c in range(0x2C00, 0x33FFF, 97) if not 0xD800 <= c < 0xE000)
    runs = ["a" * 5000, "a" * 700 + " b" * 300 + "9" * 900, " " * 3000, " " * 999 + "x", "'" * 500, "ab'" * 400, "\n" * 63 + "'re" * 99]
    return [None, "", " ", "x", "<|endoftext|>", new, *mixed, *runs, mixed[0]]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 30), (7, 3), (byte_pairs.CHUNK, byte_pairs.OVERLAP)])
def test_chunks_are_encoded_like_whole_texts(spark, whole, chunk, overlap):
    given = texts()
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(given)]
    # Repeated rows, a null key, and one key with two texts.
    rows += [rows[30], (None, "a null id " * 50, None, None, None, None), (5, "other text " * 40, "", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = byte_pairs.encode(docs, chunk=chunk, overlap=overlap).collect()
    expected = [(r[0], whole.encode_ordinary(r[1] or "")) for r in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(expected, key=key)
    assert all(r.n_tokens == len(r.ids) for r in found)


def test_stitches_meet_wherever_the_cut_falls(whole):
    v = byte_pairs.load()
    splitter, merger = byte_pairs.Splitter(v), byte_pairs.Merger(v)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "  ", "'", "re", "s", "1", "\n", ".", "é"]) for _ in range(rng.randint(40, 300)))
        chunk = rng.randint(6, 60)
        overlap = rng.randint(3, chunk - 1)
        stitcher, start = byte_pairs.Stitcher(splitter, merger), 0
        while True:
            piece, last = text[start : start + chunk], start + chunk >= len(text)
            stitcher.add(piece, start, splitter.certain(piece, last), last)
            if last:
                break
            start += chunk - overlap
        assert numbers(stitcher) == whole.encode_ordinary(text)


def test_very_long_run_is_read_a_few_times(whole):
    v = byte_pairs.load()
    splitter, merger = byte_pairs.Splitter(v), byte_pairs.Merger(v)
    text, read = "ab" * 40_000, []
    certain = splitter.certain
    splitter.certain = lambda t, last: read.append(len(t)) or certain(t, last)
    stitcher = byte_pairs.Stitcher(splitter, merger)
    for start in range(0, len(text), 900):
        piece, last = text[start : start + 1000], start + 1000 >= len(text)
        stitcher.add(piece, start, certain(piece, last), last)
        if last:
            break
    assert numbers(stitcher) == whole.encode_ordinary(text)
    assert sum(read) < 4 * len(text)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_pairs.encode(none).collect() == []
    assert byte_pairs.digests(none).collect() == []


def test_decoding_gives_the_bytes(spark, whole):
    rows = [(1, [*whole.encode_ordinary("é漢 x")]), (2, None), (3, []), (4, [None, 10_000_000, 0]), (5, [whole.encode_ordinary("😀")[0]])]
    found = {r.id: r.ids_bytes for r in byte_pairs.decode(spark.createDataFrame(rows, "id int, ids array<int>"), name="ids_bytes").collect()}
    assert bytes(found[1]).decode() == "é漢 x"
    assert found[2] is None and bytes(found[3]) == b""
    assert bytes(found[4]) == whole.decode_single_token_bytes(0)
    assert bytes(found[5]) == whole.decode_single_token_bytes(rows[4][1][0])


def test_decoded_column_takes_the_place_of_an_old_one(spark):
    rows = spark.createDataFrame([(1, [0], "old")], "id int, ids array<int>, DECODED string")
    assert byte_pairs.decode(rows).columns == ["id", "ids", "decoded"]


def test_query_columns(spark, whole):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts())], SCHEMA)
    given = dict(enumerate(texts()))
    for r in byte_pairs.digests(docs).collect():
        ids = whole.encode_ordinary(given[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((given[r.doc_id] or "").encode()).hexdigest()
