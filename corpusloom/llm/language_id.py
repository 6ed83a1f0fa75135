"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter 3-gram is bound
from its letters' vectors, each permuted (rotated) by its place; a text bundles (adds) its 3-grams,
a language the 3-grams of all its training texts. Texts are compared with the languages' prototypes
by cosine, after the part that all prototypes share is taken away. Everything else than letters
counts as one space between words.

Learning is one pass that adds up integer vectors in each partition and then by Spark; the
prototypes are as many as the languages. Predicting is one pass without a shuffle.

Cases: a null text, or one without letters, is `und` with score 0; rows with a null language teach
nothing; without any training row every text is `und`; ties go to the first language by name; rows
that repeat are each kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, id_text, small_batches

DIM = 1024
_letters: dict = {}


def is_letter() -> np.ndarray:
    if "is" not in _letters:
        _letters["is"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters["is"]


def letter_vector(code: int, dim: int) -> np.ndarray:
    if (code, dim) not in _letters:
        _letters[code, dim] = np.random.default_rng([7, code]).integers(0, 2, dim, np.int8) * np.int8(2) - np.int8(1)
    return _letters[code, dim]


def grams(text: str) -> np.ndarray:
    """The text's letter 3-grams, 21 bits a letter (0: a space), repeats included; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    codes = np.where(is_letter()[codes], codes, 0)
    if not codes.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


def gram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """One bound vector per 3-gram."""
    low = np.uint64((1 << 21) - 1)
    out = np.ones((len(codes), dim), np.int8)
    for place, shift in ((2, 42), (1, 21), (0, 0)):
        letters, at = np.unique((codes >> np.uint64(shift)) & low, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(x), dim), place) for x in letters])[at]
    return out.astype(np.float32)


def bundles(found: list[np.ndarray], dim: int) -> np.ndarray:
    """The bundled vector of each list of 3-grams (float32 holds these sums of integers exactly below 2^24)."""
    sizes = [len(x) for x in found]
    if not sum(sizes):
        return np.zeros((len(found), dim), np.float32)
    codes, at = np.unique(np.concatenate(found), return_inverse=True)
    counts = np.bincount(np.repeat(np.arange(len(found)), sizes) * len(codes) + at, minlength=len(found) * len(codes))
    counts = counts.reshape(len(found), len(codes)).astype(np.float32)
    return sum(counts[:, k : k + 4096] @ gram_vectors(codes[k : k + 4096], dim) for k in range(0, len(codes), 4096))


def learn(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """docs (text, lang) -> languages in order, and their unit prototypes with the shared part taken away."""
    small_batches(docs.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            found = [grams(t) for t in texts]
            for lang in {*langs}:
                vector = bundles([np.concatenate([found[i] for i in np.flatnonzero(langs == lang)])], dim)[0]
                total[lang] = total.get(lang, 0) + vector.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    sums = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, vector array<long>")
    sums = sums.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sorted((r.lang, [x.x for x in sorted(r.v)]) for r in sums.groupBy("lang").agg(F.collect_list(F.struct("i", "x")).alias("v")).collect())
    if not rows:
        return [], np.zeros((0, dim))
    vectors = np.array([v for _, v in rows], float)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    if len(rows) > 1:
        vectors -= vectors.mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return [lang for lang, _ in rows], vectors


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score: (1 + cosine) / 2 with the best prototype."""
    small_batches(docs.sparkSession, 512)
    dim = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = batch.column("text").to_pylist(), [], []
            for k in range(0, len(texts), 128):
                found = [grams(t) for t in texts[k : k + 128]]
                vectors = bundles(found, dim)
                cosines = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for g, c in zip(found, cosines, strict=True):
                    best = int(c.argmax()) if len(g) and len(c) else None
                    names.append("und" if best is None else languages[best])
                    scores.append(0.0 if best is None else float(np.clip((1 + c[best]) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score; learnt from the folds 0 and 2 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(fold_of(F.col("doc_id"), 3) != 1).select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = predict(docs, *learn(train))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
