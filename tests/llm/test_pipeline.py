"""The pipeline stage by stage against brute force, with odd rows among the documents."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrywright.llm import packing, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows(docs):
    first = docs.orderBy("doc_id").first()
    rows = [
        (9_000_001, None), (9_000_002, ""), (9_000_003, "  \n\t\n"), (9_000_004, "menu\nmenu\nhome"), (9_000_004, "another text of this id"),
        (9_000_005, first.text), (9_000_005, first.text), (None, "a text without an id, card 4111 1111 1111 1111"),
        (9_000_006, " ".join(f"w{i}" for i in range(5000))), (9_000_007, " ".join(f"w{i}" for i in range(4999))),
    ]
    return [(i, t, "en", "odd", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.union(spark.createDataFrame(odd_rows(docs), docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES:
        step(spark, frames[-1], folder).write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return folder, frames


def key(r):
    return (r.doc_id is not None, r.doc_id or 0)


def test_toxicity_takes_out_what_the_classifier_rejects(spark, run):
    folder, (docs, kept, *_) = run
    assert kept.columns == docs.columns
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).select("doc_id", "predicted").distinct()
    verdicts = {}
    for r in scores.collect():
        verdicts.setdefault(r.doc_id, set()).add(r.predicted)
    ids = [r.doc_id for r in kept.collect()]
    for r in docs.select("doc_id").collect():
        if len(verdicts[r.doc_id]) == 1:
            assert (r.doc_id in ids) == (verdicts[r.doc_id] == {0})
    assert {9_000_001, 9_000_002, 9_000_003} <= set(ids)


def test_lines_are_those_of_brute_force(run):
    _, (_, docs, kept, *_) = run
    rows = docs.collect()
    order = sorted(range(len(rows)), key=lambda i: key(rows[i]))
    by_id = {}
    for i in order:
        by_id.setdefault(rows[i].doc_id, []).append(i)
    seen, want = [], {}
    for i in order:
        stay = []
        for line in (rows[i].text or "").split("\n"):
            own = set(words(line))
            if not own or not any(
                min(len(own), len(v)) >= 0.8 * max(len(own), len(v)) - 1e-9 and len(own & v) >= 0.8 * len(own | v) - 1e-9 for v in seen
            ):
                stay.append(line)
            if own:
                seen.append(own)
        want[i] = None if rows[i].text is None else "\n".join(stay)
    got = {}
    for r in kept.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for doc_id, places in by_id.items():
        # Which of several rows with one id comes first is the table's order.
        if len(places) == 1:
            assert got[doc_id] == [want[places[0]]], doc_id
        assert len(got[doc_id]) == len(places)
    assert sum(a != rows[i].text for i, a in want.items()) > 10


def test_one_document_of_each_group_stays(run):
    _, (_, _, docs, kept, *_) = run
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))

    def shingles(text):
        w = words((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = sorted((rows[i].doc_id is None, rows[i].doc_id or 0) for i in set(label))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert kept.columns == docs.columns and len(want) < len(rows)


def test_pseudonyms_change_values_only(run):
    _, (_, _, _, docs, kept, _) = run
    assert kept.columns == docs.columns and kept.count() == docs.count()
    before, after = ({r.doc_id: r for r in f.collect()} for f in (docs, kept))
    for doc_id, r in before.items():
        assert (r.text is None) == (after[doc_id].text is None)
        if r.text is not None:
            assert after[doc_id].n_chars == len(after[doc_id].text)
            if not re.search("@|[0-9]", r.text):
                assert after[doc_id].text == r.text
    if None in before:
        assert "4111 1111 1111 1111" not in after[None].text


def test_every_word_is_packed_once(run):
    _, (*_, docs, bins) = run
    found = {}
    for r in bins.collect():
        found.setdefault(r.doc_id, []).append(r)
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r.doc_id, []).append(len(words(r.text)))
    for doc_id, own in sizes.items():
        pieces = found.pop(doc_id)
        assert sum(p.n_words for p in pieces) == sum(own)
        starts = sorted(s for n in own for s in range(0, max(n, 1), packing.CAPACITY))
        assert sorted(p.first_word for p in pieces) == starts
        assert sum(p.bin_id is None for p in pieces) == own.count(0)
    assert found == {}
    used = bins.filter("bin_id is not null").groupBy("bin_id").agg(F.sum("n_words").alias("n"), F.max(F.col("start") + F.col("n_words")).alias("end"))
    assert used.filter(f"n > {packing.CAPACITY} or end > {packing.CAPACITY}").count() == 0


def test_run_gives_the_last_stage(spark, run):
    folder, (*_, bins) = run
    again = corpus_pipeline.run(spark, folder)
    assert again.columns == bins.columns and again.count() == bins.count()


def test_stages_take_an_empty_table(spark, run):
    folder, (docs, *_) = run
    rows = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        rows = step(spark, rows, folder)
        assert rows.count() == 0, name


def test_odd_rows_are_packed_apart(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " more", None), (None, None, "b"), (3, "", "c"), (4, " \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = packing.pack_apart(docs, capacity=500).collect()
    assert len(found) == len(rows)
    bins = [r.bin_id for r in found if r.n_words]
    assert len(bins) == 3 and len(set(bins)) == 3  # all three are near copies of each other
    assert packing.pack_apart(docs.limit(0)).count() == 0
