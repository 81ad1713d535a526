"""The prefix trie against brute force, with sketches of every quality."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ferrywright.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, d1 string, size string"


def brute(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children[node]]
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + mine)
    return sorted(
        (
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), *sums[node],
            sha(",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))),
        )
        for node, cs in members.items()
    )


def table(seed):
    rng = random.Random(seed)
    texts = ["", None, "é漢😀", "same", "long " * 400, "a", "b"]
    rows = []
    for c in [*range(0, 24), *range(100, 130), 200, 205, 350, 399, 10**12]:
        story = [(rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for _ in range(rng.randint(1, 9))]
        for turn, (role, text) in enumerate(story):
            rows.append((c, rng.choice([turn, turn, None, 3]), role, text))
    # Copies of one conversation, which share everything, and a very long one.
    story = [(t, "user", f"turn {t}") for t in range(8)]
    rows += [(1000 + 100 * k, *t) for k in range(40) for t in story]
    rows += [(5000, t, "user", f"turn {t}") for t in range(500)] + [(5100, t, "user", f"turn {t}") for t in range(300)]
    # Without a base, and with no turns but those that it would replace.
    rows += [(c, 0, "user", "only") for c in range(701, 720)]
    return [*rows, rows[0], rows[0], (None, 0, "user", "nobody's")]


def found(spark, rows, width=None):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefix_trie.nodes(frame, width).collect())


@pytest.mark.parametrize(("seed", "width"), [(1, None), (2, 1 << 14), (3, 64), (4, 1)])
def test_nodes_like_brute_force(spark, seed, width):
    rows = table(seed)
    expected = brute(rows)
    assert found(spark, rows, width) == expected
    assert any(n[1] == 0 and n[-1] != hashlib.sha256(b"").hexdigest() for n in expected)  # turnless ones


def test_one_conversation(spark):
    for rows in ([(7, 0, "user", "x")], [(100, 0, "user", "x"), (100, 1, None, None)]):
        assert found(spark, rows) == brute(rows)


def test_role_and_text_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (100, 0, "a", "bc"), (200, 0, "", "abc"), (300, 0, "ab", "c")]
    assert found(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []


def test_sketch_never_counts_too_low(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(-(2**62), 2**62, (4000, 2))
    rows = [tuple(map(int, v)) for v in np.concatenate([values, values[:500], values[:20]])]
    frame = spark.createDataFrame(rows, "d1 long, d2 long").repartition(7)
    for width, most in ((1 << 16, 0.02), (64, 1.0)):
        sketch = prefix_trie.sketch(frame, width)
        alone = sketch.alone(values[:, 0], values[:, 1])
        assert not alone[:500].any()
        assert (~alone[500:]).mean() <= most
