"""Licence notices in documents: a paragraph classifier whose findings a template must confirm.

A paragraph is a line, or several: neighbouring lines that speak of licences are read as one where that
shows a family, as notices are often wrapped. A logistic regression over its word n-grams tells the licence
families, texts about licences of no known family, and everything else apart. It is
trained on variants of templates and on paragraphs of the corpus itself, its
probabilities are calibrated on variants that were held back, and a paragraph whose best
family is not probable enough, or whose words do not contain enough of a template of that
family, counts as unknown.
"""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import small_batches
from ferrywright.session import stage

# Usual wordings of licence notices by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted.",
        "SPDX-License-Identifier: ISC",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).",
    ),
    "public": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ),
}
# Wordings about licences that name no family above.
OTHERS = (
    "All rights reserved.",
    "Copyright by the authors. All rights reserved. No part may be reproduced without permission.",
    "Licensed under the terms of the commercial license agreement.",
    "Use of this document is subject to the terms of the license.",
    "See the license file for the terms and conditions of use.",
    "Proprietary and confidential. Unauthorized copying of this file is prohibited.",
)
NONE, UNKNOWN = "none", "unknown"
LABELS = (NONE, UNKNOWN, *TEMPLATES)
# Variants of each template, those held back for calibration, and paragraphs of the corpus to learn from.
VARIANTS = 60
HELD_BACK = 4
CORPUS_SAMPLE = 5000
# Least calibrated probability of a family, and least share of a template's n-grams that a paragraph must have.
LEAST_PROBABILITY = 0.6
LEAST_CONTAINED = 0.6
LONGEST = 3
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(tokens: list[str]) -> list[str]:
    """All runs of one to LONGEST words, joined by spaces."""
    return [" ".join(tokens[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(tokens) - n + 1)]


def variants(template: str, filler: list[str], rng: random.Random):
    """Token lists like those in which the template occurs: cut, with words lost, among other words."""
    tokens = words(template)
    yield tokens
    for _ in range(VARIANTS - 1):
        some = tokens
        if len(some) > 12 and rng.random() < 0.5:
            size = rng.randint(10, len(some))
            start = rng.randint(0, len(some) - size)
            some = some[start : start + size]
        if len(some) > 5:
            some = [w for w in some if rng.random() > 0.05]
        if filler and rng.random() < 0.6:
            front, back = (rng.choices(filler, k=rng.choice((0, 3, 10, 40))) for _ in range(2))
            some = front + some + back
        yield some


class Model:
    """What the tasks need to classify a paragraph."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.at = {g: i for i, g in enumerate(vocabulary)}
        self.first = {g.split(" ")[0] for g in vocabulary}
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.templates = {
            family: [frozenset(ngrams(words(t))) for t in texts] for family, texts in TEMPLATES.items()
        }

    def logits(self, tokens: list[str]) -> tuple[np.ndarray, set[str]]:
        """Of a paragraph; n-grams that begin with no word of the vocabulary are not even made."""
        grams = set()
        for i, word in enumerate(tokens):
            if word in self.first:
                for n in range(1, LONGEST + 1):
                    if i + n <= len(tokens):
                        gram = word if n == 1 else " ".join(tokens[i : i + n])
                        if gram in self.at:
                            grams.add(gram)
        return self.bias + self.weights[:, [self.at[g] for g in grams]].sum(axis=1), grams

    def contained(self, family: str, grams: set[str]) -> float:
        return max(len(t & grams) / len(t) for t in self.templates[family])

    def classify(self, tokens: list[str]) -> tuple[str, float, float]:
        """(family, calibrated probability, share of the best template) of a paragraph."""
        logits, grams = self.logits(tokens)
        p = np.exp((logits - logits.max()) / self.temperature)
        p /= p.sum()
        best = int(p.argmax())
        label = LABELS[best]
        if label == NONE:
            return NONE, float(p[best]), 0.0
        if label == UNKNOWN:
            return UNKNOWN, float(p[best]), 0.0
        share = self.contained(label, grams)
        sure = p[best] >= LEAST_PROBABILITY and share >= LEAST_CONTAINED
        return (label if sure else UNKNOWN), float(p[best]), share


def corpus_paragraphs(docs: DataFrame, text: str, bound: int) -> DataFrame:
    """At most `bound` different paragraphs, chosen by a hash.

    Paragraphs are counted first, so that little more than `bound` of them are ever put in order.
    """
    lines = docs.select(F.explode(F.split(F.col(text).cast("string"), "\n")).alias("line")).filter(F.length("line").between(20, 2000))
    different = lines.agg(F.approx_count_distinct("line")).first()[0]
    mark = F.shiftrightunsigned(F.xxhash64("line", F.lit(1)), 32)
    some = lines.filter(mark < F.lit(min(1 << 32, ((2 * bound) << 32) // max(different, 1)))).distinct()
    return some.orderBy(mark, "line").limit(bound)


def train(docs: DataFrame, text: str = "text", bound: int = CORPUS_SAMPLE) -> Model:
    """The classifier; paragraphs of the corpus that hold most of a template are not learned as others."""
    session, rng = docs.sparkSession, random.Random(7)
    sample = sorted({row.line for row in corpus_paragraphs(docs, text, bound).collect()})
    plain = [words(line) for line in sample]
    shortest = [frozenset(ngrams(words(t))) for texts in TEMPLATES.values() for t in (*texts, *OTHERS)]
    cues = {w for t in shortest for g in t for w in g.split(" ") if len(w) > 3}
    plain = [p for p in plain if sum(w in cues for w in p) < 2]
    filler = [w for p in plain[:500] for w in p][:20_000]
    rows, held = [], []
    for label, templates in ((UNKNOWN, OTHERS), *TEMPLATES.items()):
        for template in templates:
            for k, tokens in enumerate(variants(template, filler, rng)):
                (held if k % HELD_BACK == 1 else rows).append((LABELS.index(label), tokens))
    for k, tokens in enumerate(plain):
        (held if k % HELD_BACK == 1 else rows).append((0, tokens))
    own = defaultdict(int)
    for texts in (*TEMPLATES.values(), OTHERS):
        for t in texts:
            for g in set(ngrams(words(t))):
                own[g] += 1
    vocabulary = sorted(own)
    seen = set(vocabulary)
    data = [(float(y), [g for g in set(ngrams(tokens)) if g in seen]) for y, tokens in rows]
    frame = session.createDataFrame(data, "label double, grams array<string>")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    ready = stage(counter.transform(frame.repartition(6)).select("label", "features"), "paragraph_features")
    fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, standardization=False).fit(ready)
    model = Model(vocabulary, fit.coefficientMatrix.toArray(), fit.interceptVector.toArray(), 1.0)
    model.temperature = calibrated(np.array([model.logits(t)[0] for _, t in held]), np.array([y for y, _ in held]))
    return model


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the labels held back are likeliest."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    return min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)


def _neighbours(found: list[tuple]) -> list[list[tuple]]:
    """Findings in runs of neighbouring lines."""
    runs: list[list[tuple]] = []
    for f in found:
        if runs and runs[-1][-1][0] == f[0] - 1:
            runs[-1].append(f)
        else:
            runs.append([f])
    return runs


def _read_as_one(run: list[tuple], model: Model) -> list[tuple]:
    """The findings of neighbouring lines; those between confirmed ones become one where together they show a family.

    Lines that are confirmed by themselves stay as they are.
    """
    out: list[tuple] = []
    for unsure, part in itertools.groupby(run, key=lambda f: f[1] == UNKNOWN):
        lines = list(part)
        if unsure and len(lines) > 1:
            label, p, share = model.classify([w for f in lines for w in f[4]])
            if label not in (NONE, UNKNOWN):
                lines = [(lines[0][0], label, p, share, [])]
        out += lines
    return out


_SCHEMA = "family string, n_notices long, n_unknown long, probability double, contained double, lines string"


def licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of `docs`: id, family, n_notices, n_unknown, probability, contained and lines.

    family is that of the most probable notice, `unknown` if there are only unconfirmed ones,
    else `none`. lines lists line:family of every notice; one that is wrapped counts once, at its first line. Null and empty texts have none,
    rows that repeat get equal results, an empty table gives no rows.
    """
    small_batches(docs)
    model = model or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(body: str, model: Model):
        found = []
        for i, line in enumerate(body.split("\n")):
            tokens = words(line)
            # Without two words that begin an n-gram of the vocabulary a paragraph is like an empty one.
            if sum(w in model.first for w in tokens) >= 2:
                label, p, share = model.classify(tokens)
                if label != NONE:
                    found.append((i, label, p, share, tokens))
        found = [f[:4] for run in _neighbours(found) for f in _read_as_one(run, model)]
        named = [f for f in found if f[1] != UNKNOWN]
        best = max(named or found, key=lambda f: (f[2], -f[0]), default=(0, NONE, 1.0, 0.0))
        lines = ",".join(f"{i}:{label}" for i, label, _, _ in found)
        return best[1], len(named), len(found) - len(named), best[2], best[3], lines

    def run(batches):
        model = shared.value
        for batch in batches:
            rows = [scan(t or "", model) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["id", "family", "n_notices", "n_unknown", "probability", "contained", "lines"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names)

    return narrow.mapInArrow(run, f"id {kind}, {_SCHEMA}").withColumnRenamed("id", id_col)
