"""Spelling variants against brute force over a small table."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from ferrywright.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, key string, run string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            check = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            k = check % len(run)
            count[run[:k] + run[k + 1 :] if check % 97 == 0 else run] += 1
    known = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in known if one_apart(w, v)] for w in known}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 2 * known[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), known[form[w]] if form[w] else None) for w, n in known.items())


def table(seed):
    rng = random.Random(seed)
    letters = "abcdeé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(25)]
    words = list(base)
    for w in base * 6:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]]))
        words.append(words[-1][:2] + rng.choice(letters) + words[-1][2:])
    some = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=300)).replace("a", "A", 40)) for i in range(20)]
    return [*some, some[0], (None, some[1][1]), (50, None), (51, ""), (52, " \n12 漢"), (53, "straße-straße, STRASSE ")]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k", "r") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("parts", [3, 6])
@pytest.mark.parametrize("seed", [1, 2])
def test_variants_like_brute_force(spark, seed, parts):
    rows = table(seed)
    found = sorted((tuple(r) for r in spelling.variants(rows_of(spark, rows), parts=parts).collect()), key=lambda r: r[0])
    expected = brute(rows)
    assert found == expected
    assert any(r[1] and r[2] != r[1] for r in expected) and any(r[1] is None for r in expected)


def test_pairs_of_long_and_repetitive_words(spark):
    words = ["a" * 300, "a" * 301, "a" * 302, "b" + "a" * 299, "ab" * 100, "ba" * 100, "ab" * 100 + "a", "aaaaa", "aaaab", "baaaa"]
    known = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    found = {(r.a, r.b) for r in spelling.near_pairs(known).collect()}
    expected = {(a, b) for a in words for b in words if one_apart(a, b) and (len(a) < len(b) or (len(a) == len(b) and a < b))}
    assert found == expected


def test_too_few_parts(spark):
    with pytest.raises(ValueError):
        spelling.near_pairs(spark.createDataFrame([("abcde", 3)], "word string, n long"), parts=2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "rare words only")]])
def test_no_words(spark, rows):
    assert spelling.variants(rows_of(spark, rows)).collect() == []


def test_one_word_without_neighbours(spark):
    found = spelling.variants(rows_of(spark, [(1, "lonely " * 5)])).collect()
    assert [(r.word, r.form, r.root, r.n_near, r.form_n) for r in found] == [("lonely", None, "lonely", 0, None)]
