"""Trained operators, pieces, vectors and the pipeline."""

from __future__ import annotations

import os
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrywright.llm import license_scan, pieces, toxicity, vector_graph

FOLDER = "/root/testdata/sf0.001"


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [a + b for a in ("ta", "ro", "mi", "le", "su") for b in ("n", "rk", "st", "va", "li", "do")]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=60)
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(60)] = "zgrump"
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_is_learned_and_held_out(spark):
    docs, labels = corpus(400)
    odd = [(9001, None), (9002, ""), (None, "zgrump zgrump")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    held = [i for i, _ in labels if rows[i].held_out]
    assert 0.1 < len(held) / 400 < 0.3
    assert all(rows[i].predicted == y for i, y in labels if i in set(held))
    assert rows[9001].score == rows[9002].score and rows[9001].predicted == 0
    assert rows[None].predicted == 1


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(d, lab).first().score == 0.5
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_ngrams_across_portions(monkeypatch):
    text = "some words here ab" + " " * 50 + "cd, then\t more  words; \n\n and the ENDING of it all"
    whole = toxicity.ngram_codes(text)
    for block in (1, 3, 7, 18, 20, 45, 69):
        monkeypatch.setattr(toxicity, "_BLOCK", block)
        assert np.array_equal(toxicity.ngram_codes(text), whole)
    monkeypatch.setattr(toxicity, "_BLOCK", 1 << 18)
    # The same words with single spaces have the same n-grams.
    assert np.array_equal(toxicity.ngram_codes(" ".join(re.findall("[a-z]+", text.lower()))), whole)


def test_wrapped_notices_are_read_as_one(spark):
    docs, _ = corpus(60, 4)
    texts = [(f, t) for f in ("mit", "apache", "gpl", "lgpl", "bsd", "isc") for t in license_scan.TEMPLATES[f] if len(t) > 100]
    rows, want = list(docs), {}
    for family, t in texts:
        for width in (60, 70, 80):
            want[1000 + len(want)] = family
            rows.append((999 + len(want), docs[len(want)][1] + "\n\n" + textwrap.fill(t, width)))
    frame = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string").withColumn("family", F.lit("kept apart"))
    got = license_scan.licences(frame.select("*", F.lit(1).alias("id"))).collect()
    named = {r.doc_id: r.family for r in got if r.doc_id >= 1000}
    assert named == want
    assert {r.family for r in got if r.doc_id < 1000} == {"none"}
    assert len({tuple(r) for r in got if r.doc_id == rows[-1][0]}) == 1


def test_the_licence_sample_is_bounded_and_of_different_paragraphs(spark):
    lines = "\n".join(f"paragraph number {i} of the text" for i in range(500))
    docs = spark.createDataFrame([(i, lines) for i in range(20)] + [(99, None)], "doc_id long, text string")
    got = [r.line for r in license_scan.corpus_paragraphs(docs, "text", 100).collect()]
    assert len(got) == len(set(got)) == 100
    assert license_scan.corpus_paragraphs(docs, "text", 5000).count() == 500
    assert license_scan.corpus_paragraphs(docs.limit(0), "text", 100).count() == 0


def test_licences(spark):
    docs, _ = corpus(60, 4)
    notices = {
        1: ("mit", "Released under the MIT License."),
        2: ("gpl", "This work is licensed under the GNU General Public License, version 3."),
        3: ("unknown", "All rights reserved."),
    }
    rows = [(i, t + ("\n" + notices[i][1] if i in notices else "")) for i, t in docs]
    got = license_scan.licences(spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, text string"))
    assert {r.doc_id: r.family for r in got.collect() if r.family != "none"} == {i: f for i, (f, _) in notices.items()}


def brute_pieces(word, p):
    single_bytes = set(p.byte_piece.tolist())
    vocabulary = {s: i for i, s in enumerate(p.surface) if s and i not in single_bytes}
    starts = [i for i in range(len(word)) if word[i] & 0xC0 != 0x80] + [len(word)]
    best, back = {0: 0.0}, {}
    for a, i in enumerate(starts[:-1]):
        single = False
        for c in range(a + 1, len(starts)):
            j = starts[c]
            if word[i:j] in vocabulary:
                single |= c == a + 1
                total = best[i] + p.score[vocabulary[word[i:j]]]
                if total > best.get(j, -np.inf):
                    best[j], back[j] = total, (i, [vocabulary[word[i:j]]])
        j = starts[a + 1]
        if not single and best[i] + p.unknown > best.get(j, -np.inf):
            best[j], back[j] = best[i] + p.unknown, (i, [int(p.byte_piece[x]) for x in word[i:j]])
    out, end = [], len(word)
    while end:
        end, ids = back[end]
        out = ids + out
    return out


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_pieces(spark):
    p = pieces.load()
    rng = random.Random(2)
    words = ["".join(rng.choice(" abcdeéß漢😀▁the ing") for _ in range(rng.randint(1, 14))).encode() for _ in range(150)]
    for q in (p, pieces.scored(p, np.random.default_rng(3).integers(0, 99, len(p.surface)))):
        ids, lengths = pieces.segment(words, q)
        assert [g.tolist() for g in np.split(ids, np.cumsum(lengths)[:-1])] == [brute_pieces(w, q) for w in words]
    texts = [None, "", " ", "  two  spaces ", "literal ▁ marker", "new\nline\ttab", "漢字😀", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pieces.encode(df).collect()
    assert all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(rows)).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_pieces_of_whole_words(spark):
    texts = ["the population of the world", "a population and its government", None, "漢字😀 population"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    p = pieces.load()
    own = [i for i, s in enumerate(p.surface) if s == b" population"]
    rows = {r.doc_id: r for r in pieces.encode(df).collect()}
    assert own and all(own[0] in rows[i].ids for i in (0, 1, 3)) and all(r.round_trip for r in rows.values())
    q = pieces.estimate(df, p)
    ends = np.unique(q.piece[q.piece >= 0])
    assert abs(np.exp(q.score[ends]).sum() - 1) < 1e-6


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_estimated_pieces_like_brute_force(spark):
    texts = ["the population of the world", "the the  population", None, "", "漢字😀 population\nof", "the population of the world"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, word string")
    p = q = pieces.load()
    q = pieces.scored(q, np.zeros(len(q.surface)))
    for _ in range(pieces.ROUNDS):
        counts = np.zeros(len(q.surface))
        for t in texts:
            for word in pieces._WORD.findall(" " + (t or "")):
                np.add.at(counts, brute_pieces(word.encode(), q), 1)
        q = pieces.scored(q, counts)
    got = pieces.estimate(df, p)
    assert np.allclose(got.score, q.score) and got.unknown == pytest.approx(q.unknown)
    rows = {r.doc_id: r for r in pieces.encode(df).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == [x for w in pieces._WORD.findall(" " + (t or "")) for x in brute_pieces(w.encode(), q)]
    assert rows[0].ids == rows[5].ids and rows[3].n_pieces == 1
    assert pieces.encode(df.limit(0)).collect() == []


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = base[:40].repeat(3, axis=0) + rng.normal(scale=0.03, size=(120, 16))
    x = np.concatenate([base, near, base[:5], np.zeros((1, 16))])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, base[0].tolist(), None), (903, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_graph.near_vectors(df).collect()}
    assert len(got) == len(rows)
    n = len(x)
    norm = np.linalg.norm(x, axis=1)
    u = x / np.where(norm > 0, norm, 1)[:, None]
    label = np.arange(n) % 3
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(n, dtype=bool)
    assert [got[i].n_links for i in range(n)] == link.sum(axis=1).tolist()
    root = np.arange(n)
    for _ in range(n):
        new = np.minimum(root, np.where(link, root[None], n).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert [got[i].component_id for i in range(n)] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (n - 1, 900, 901, 902, 903))
    assert vector_graph.near_vectors(df.limit(0)).count() == 0


def test_shards_overlap_and_find_all(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(scale=0.01, size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "row long, v array<double>, label int")
    _, nodes = vector_graph.nodes_of(df, "label", "v")
    shards = vector_graph.shards_of(nodes, shard=120)
    assert shards.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 120
    assert shards.select("node").distinct().count() == 400
    pairs = vector_graph.range_pairs(nodes, shards, vector_graph.build(shards), 0.98, 24)
    assert vector_graph.audited_recall(nodes, pairs, 0.98) >= 0.9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_a_search_holds_little_of_each_query():
    import tracemalloc

    n, rng = 40_000, np.random.default_rng(5)
    turn = np.arange(n) * 0.002 + rng.uniform(0, 1e-4, n)
    x = np.stack([np.cos(turn), np.sin(turn)], 1)
    nbr = np.stack([(np.arange(n) - 1) % n, (np.arange(n) + 1) % n, (np.arange(n) + 1571) % n], 1).ravel()
    queries = np.arange(0, 1280, 10)
    tracemalloc.start()
    q, node = vector_graph.search(x, np.arange(n + 1) * 3, nbr, 0, queries, 0.999_99, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A byte per query and vector, not several numbers.
    assert peak < 4 * len(queries) * n
    assert (np.einsum("ij,ij->i", x[q], x[node]) >= 0.999_99).all()
    assert set(queries) <= set(q[q == node]) and len(set(zip(q, node))) == len(q)


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert sorted(out.columns) == sorted(docs.columns), name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()
