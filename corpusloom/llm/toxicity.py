"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words and word beginnings. Besides the log loss it pays for every
change of a training text's logit when an identity term in it is swapped for another term, so that
a neutral mention of a group does not raise a score. It is fitted on a bounded sample of labelled
rows (`most_rows`, in the order of a hash of the id; the default is far above what the features
need); Spark counts the features' document frequencies, selects the telling ones (`least_texts`,
`least_z`, `most_features`: the model's size, as the rows it is fitted on are bounded too), turns the
sample into sparse rows, and scores every text in one pass without a shuffle.

Cases: a null or empty text gets the score of the intercept; rows that repeat are each scored and
teach once per id (of texts that share an id the least one); an id with several labels counts as toxic
if one of them says so; rows without
a label teach nothing; with no labelled row, or labels of one kind alone, every score is that kind's
share (0 without rows); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, id_text, small_batches, written

# Group terms that are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
)
SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, t in enumerate(group)}
_words = re.compile(r"\w+").findall


def features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of 3 to 6 letters."""
    return (word, *(f"{word[:n]}*" for n in range(3, 7) if len(word) > n))


class Model:
    """Weights of features; picklable, of the size of the selection."""

    def __init__(self, weights: dict[str, float], intercept: float, most: int = 300_000):
        self.weights, self.intercept, self.most = weights, intercept, most
        self.memo: dict[str, tuple[str, ...]] = {}

    def logit(self, text: str) -> float:
        memo, words = self.memo, {*_words(text.lower())}
        if len(memo) > self.most:
            memo.clear()
        found = set()
        for w in words:
            if (hit := memo.get(w)) is None:
                hit = memo[w] = tuple(f for f in features(w) if f in self.weights)
            if hit:
                found.update(hit)
        return self.intercept + math.fsum(self.weights[f] for f in found)

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.logit(text)))))


def _frequencies(sample: DataFrame) -> DataFrame:
    """feature, pos, neg: texts of each label that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in {*chain.from_iterable(map(features, {*_words(text.lower())}))}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in (1, 0))], ["feature", "pos", "neg"])

    return sample.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _rows(sample: DataFrame, place: dict[str, int]) -> DataFrame:
    """toxic, here, swapped: selected features of a text, and of it with identity terms swapped (null without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(words):
            return sorted({place[f] for w in words for f in features(w) if f in place})

        for batch in batches:
            words = [{*_words(t.lower())} for t in batch.column("text").to_pylist()]
            swapped = [found({SWAP.get(w, w) for w in x}) if x & SWAP.keys() else None for x in words]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(map(found, words), pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["toxic", "here", "swapped"])

    return sample.mapInArrow(run, "toxic int, here array<int>, swapped array<int>")


def fit(rows: list, n: int, swap_weight: float = 1.0, decay: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam on log loss + swap_weight * mean squared logit change + decay * |w|^2."""

    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([*chain.from_iterable(lists)], np.int64)

    y = np.array([r.toxic for r in rows], float)
    at, col = sparse([r.here for r in rows])
    pairs = [r for r in rows if r.swapped is not None]
    p_at, p_col = sparse([r.here for r in pairs])
    q_at, q_col = sparse([r.swapped for r in pairs])
    w, b = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, steps + 1):
        z = b + np.bincount(at, w[col], len(y))
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.bincount(col, miss[at], n) / len(y) + 2 * decay * w
        if pairs:
            change = np.bincount(p_at, w[p_col], len(pairs)) - np.bincount(q_at, w[q_col], len(pairs))
            grad += 2 * swap_weight / len(pairs) * (np.bincount(p_col, change[p_at], n) - np.bincount(q_col, change[q_at], n))
        full = np.append(grad, miss.mean())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 16_384, least_texts: int = 3, least_z: float = 3.0, swap_weight: float = 1.0) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): the rows to learn from, at most most_rows of them.

    Features are those in at least `least_texts` texts whose log odds between the labels lie `least_z`
    standard errors from 0, the most telling first. swap_weight is the price of a logit's change when
    identity terms are swapped; 0 gives a plain classifier.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # a few bytes each: the bound that lets it be broadcast
    texts = id_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    texts = written(texts.repartition(2 * spark.sparkContext.defaultParallelism), "toxic-sample")
    kinds = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = kinds.get(1, 0), kinds.get(0, 0)
    if not pos or not neg:
        return Model({}, 500.0 if pos else -500.0)
    p, q = (F.col("pos") + 0.5) / (pos + 1), (F.col("neg") + 0.5) / (neg + 1)
    # How far the log odds of a feature between the labels lie from 0, in standard errors.
    z = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    picked = _frequencies(texts).where(F.col("pos") + F.col("neg") >= least_texts).withColumn("z", z).where(F.col("z") > least_z).orderBy(F.desc("z"), "feature").limit(most_features).select("feature")
    identity = {f for t in SWAP for f in features(t)}
    place = {f: i for i, f in enumerate(dict.fromkeys([*(r.feature for r in picked.collect()), *sorted(identity)]))}
    w, b = fit(_rows(texts, place).collect(), len(place), swap_weight)
    return Model({f: float(w[i]) for f, i in place.items() if w[i]}, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(model.score, batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def learn_from_folds(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labels of the folds 1 to 4 of 5."""
    return learn(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", "toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, learn_from_folds(docs, labels))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5; decided row by row, without a join."""
    small_batches(docs.sparkSession)
    # All columns as one, whatever they are called.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(t) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.select(["row"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
