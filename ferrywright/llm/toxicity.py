"""Toxicity of texts: a linear classifier on character n-grams weighed by naive Bayes.

Whether an n-gram occurs in a text is its feature. Each feature is scaled by its log-count
ratio, that is how much likelier it is in toxic texts than in others, and a logistic
regression learns the rest. Counting, selecting features and fitting are Spark jobs over
a bounded sample of labelled texts; every text is scored whole, in portions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import fresh, small_batches
from ferrywright.session import discard, stage

# Most labelled texts that are learned from: the bound of the training sample.
SAMPLE = 20_000
# Broadcast no more chosen ids than this.
MOST_BROADCAST = 500_000
# Most n-grams that get a weight, chosen by how surely they tell the classes apart.
FEATURES = 4096
LENGTHS = (3, 4, 5, 6)
# An n-gram is one of this many codes.
CODES = 1 << 20
# Labels whose id has this remainder are held out.
FOLDS = 5
_LEAST_TEXTS = 5
_BLOCK = 1 << 18
_FACTOR = np.uint32(0x9E3779B1)
_SPACE = np.uint32(32)


def _blocks(text: str):
    """Code points in lower case, in portions that overlap by the longest n-gram less one.

    White space and characters that are no letters become one space, also where a run of
    them goes on in the next portion; what overlaps is what was made of the text.
    """
    text = text.lower()
    tail = np.array([], np.uint32)
    for start in range(0, max(len(text), 1), _BLOCK):
        points = np.frombuffer(text[start : start + _BLOCK].encode("utf-32-le", "replace"), np.uint32)
        letter = (points - np.uint32(97) < 26) | (points > 127)
        points = np.concatenate([tail, np.where(letter, points, _SPACE)])
        if len(points) > 1:
            points = points[np.concatenate([[True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)])]
        yield points
        tail = points[-(max(LENGTHS) - 1) :]


def _codes(points: np.ndarray):
    """For each length of n-gram the codes at all places of a portion."""
    code = np.zeros(len(points), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(points) < n:
            return
        code = (code[: len(points) - n + 1] ^ points[n - 1 :]) * _FACTOR
        code ^= code >> np.uint32(15)
        if n in LENGTHS:
            yield (code + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(12)


def ngram_codes(text: str) -> np.ndarray:
    """The distinct codes of all n-grams of a text."""
    seen = np.zeros(CODES, bool)
    for points in _blocks(text):
        for codes in _codes(points):
            seen[codes] = True
    return np.flatnonzero(seen)


def held_out(id_col: str = "doc_id"):
    """Whether labels of this id are kept from learning."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, bound: int) -> DataFrame:
    """Columns (text, y) of at most `bound` labelled texts that are not held out, chosen by a hash of their ids."""
    known = labels.filter(~held_out(id_col) & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(bound)
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # The texts stay where they are: what meets them has `bound` rows at most.
    return texts.join(F.broadcast(chosen) if bound <= MOST_BROADCAST else chosen, id_col).select("text", "y")


def learn(sample: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(codes, weights, intercept) of the classifier; without both classes no codes and an even score."""
    small_batches(sample)

    # Bounded, and often read from few files.
    texts = stage(sample.repartition(24), "labelled_texts")
    sizes = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    nothing = np.array([], np.int64), np.array([]), 0.0
    if not 0 < sizes.toxic < sizes.n:
        return nothing

    def count(batches):
        totals = np.zeros((2, CODES), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y")):
                totals[y.as_py(), ngram_codes(text.as_py())] += 1
        codes = np.flatnonzero(totals.any(axis=0))
        columns = [codes.astype(np.int32), totals[1, codes], totals.sum(axis=0)[codes]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "toxic", "n"])

    counts = texts.mapInArrow(count, "code int, toxic long, n long").groupBy("code")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    toxic_share = (F.col("toxic") + 1) / F.lit(sizes.toxic + 2)
    other_share = (F.col("n") - F.col("toxic") + 1) / F.lit(sizes.n - sizes.toxic + 2)
    ratio = F.log(toxic_share / other_share)
    # How many standard errors the difference between the two shares is away from none.
    share = (F.col("n") + 2) / F.lit(sizes.n + 4)
    error = F.sqrt(share * (1 - share) * F.lit(1 / (sizes.toxic + 1) + 1 / (sizes.n - sizes.toxic + 1)))
    surety = F.abs(toxic_share - other_share) / error
    chosen = counts.filter(F.col("n") >= _LEAST_TEXTS).select("code", ratio.alias("r"), surety.alias("s"))
    top = sorted((row.code, row.r) for row in chosen.orderBy(F.desc("s"), "code").limit(features).collect())
    if not top:
        return nothing
    known = np.array([code for code, _ in top])
    names = [str(code) for code in known]

    def name(batches):
        for batch in batches:
            codes = [np.intersect1d(ngram_codes(t.as_py()), known).astype(str).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.list_(pa.string())), batch.column("y").cast(pa.float64())], ["names", "label"]
            )

    rows = texts.mapInArrow(name, "names array<string>, label double")
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="names", outputCol="seen").setBinary(True)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r for _, r in top]), inputCol="seen", outputCol="features")
    ready = stage(scale.transform(counted.transform(rows)).select("label", "features"), "features")
    model = LogisticRegression(regParam=0.001, standardization=False, maxIter=40).fit(ready.coalesce(6))
    discard(texts, ready)
    weights = model.coefficients.toArray() * np.array([r for _, r in top])
    return known.astype(np.int64), weights, float(model.intercept)


def with_scores(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """Every column of `docs` and the score of its text, between 0 and 1."""
    small_batches(docs)
    codes, weights, intercept = model
    share = docs.sparkSession.sparkContext.broadcast((codes, weights, intercept))
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches):
        codes, weights, intercept = share.value
        place = np.full(CODES, -1, np.int32)
        place[codes] = np.arange(len(codes), dtype=np.int32)

        def score(value) -> float:
            seen = np.zeros(len(codes), bool)
            for points in _blocks(value or ""):
                for at in _codes(points):
                    found = place[at]
                    seen[found[found >= 0]] = True
            z = np.clip(intercept + weights[seen].sum(), -500, 500)
            return float(1 / (1 + np.exp(-z)))

        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    bound: int = SAMPLE,
) -> DataFrame:
    """Columns id, held_out, score and predicted for every row of `docs`.

    Null and empty texts get the score of a text without n-grams. Rows that repeat get the
    same score. Labels other than 0 and 1, or of a null id, are not learned from; of several
    labels of an id the larger one counts. Without texts of both classes every score is 0.5.
    An empty table gives no rows.
    """
    model = learn(training_sample(docs, labels, id_col, text, label, bound))
    scored = with_scores(docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")), model)
    out = scored.select(F.col("id").alias(id_col), "score")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    bound: int = SAMPLE,
) -> DataFrame:
    """`docs` without those whose text is predicted to be toxic; otherwise as `toxicity`."""
    model = learn(training_sample(docs, labels, id_col, text, label, bound))
    (name,) = fresh(docs, "_score")
    return with_scores(docs, model, text, name).filter(F.col(name) < 0.5).drop(name)
