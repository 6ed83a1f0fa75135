"""The backends that come with the library, by kind and name.

chunker: table functions of SQL, (text, size, overlap) -> index, start, end, content. embedder: Column of
texts -> array<double>. reranker: Columns of questions and texts -> double. compiler: DataFrame ->
DataFrame with one_line, key_points, detailed_summary, concepts. Others are added with `plugins.backend`.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import query_terms, sentences
from corpusloom.operators import compile as C
from corpusloom.operators import segment as S
from corpusloom.plugins import BACKENDS, backend

SPAN = "index int, start int, end int, content string"
WORD = re.compile(r"[a-z0-9_]+|[一-鿿]")


def by_windows(text: str, size: int, overlap: int) -> list[S.Span]:
    """Windows of `size` characters, each `overlap` into the one before."""
    n = max(1, -(-(len(text) - overlap) // (size - overlap))) if text else 0
    return [(i * (size - overlap), min(len(text), i * (size - overlap) + size)) for i in range(n)]


def _table_function(split):
    """A class that Spark calls for each row: eval gives the row's chunks."""

    class Chunker:
        def eval(self, text: str, size: int, overlap: int):
            text = text or ""
            for i, (a, b) in enumerate(split(text, size, overlap)):
                yield i, a, b, text[a:b]

    return F.udtf(Chunker, returnType=SPAN)


for _name, _split in {**S.SPLITTERS, "fixed": by_windows}.items():
    backend("chunker", _name)(_table_function(_split))


def register_chunkers(spark: SparkSession) -> None:
    """Every chunker as the table function chunk_<name> of the session's SQL."""
    for name, f in BACKENDS["chunker"].items():
        spark.udtf.register(f"chunk_{name}", f)


def chunked(docs: DataFrame, chunker: str, size: int, overlap: int) -> DataFrame:
    """src_id, strategy, index, start, end, content of docs (src_id, text) by the chunker of that name, through LATERAL."""
    spark = docs.sparkSession
    if chunker not in BACKENDS["chunker"]:
        raise ValueError(f"unknown chunker {chunker!r}; there are: {', '.join(sorted(BACKENDS['chunker']))}")
    register_chunkers(spark)
    return spark.sql(f"SELECT d.src_id, '{chunker}' AS strategy, c.* FROM {{docs}} d, LATERAL chunk_{chunker}(d.text, {int(size)}, {int(overlap)}) c", docs=docs.select("src_id", "text"))


backend("embedder", "letters")(S.letter_vector)


@backend("embedder", "hashed")
def hashed_words(text: Column, width: int = 64) -> Column:
    """A vector of length 1: each word adds or takes one at a place that its hash names."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(width)
            for w in WORD.findall((t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h & 0x8000_0000 else -1
            return (v / (np.sqrt(v @ v) or 1)).tolist()

        return texts.map(one)

    return run(text)


@backend("reranker", "overlap")
def term_overlap(question: Column, text: Column) -> Column:
    """Share of the question's terms that the text has."""
    terms = query_terms(question)
    return F.size(F.array_intersect(query_terms(text), terms)) / F.greatest(F.size(terms), F.lit(1))


@backend("reranker", "dice")
def word_dice(question: Column, text: Column) -> Column:
    """Twice the words that both have, by the words of both."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        a, b = ([{*WORD.findall((x or "").lower())} for x in s] for s in (q, t))
        return pd.Series([2 * len(x & y) / max(1, len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return run(question, text)


backend("compiler", "extractive")(C.extractive)


@backend("compiler", "leading")
def leading(docs: DataFrame) -> DataFrame:
    """The first sentences alone: no concepts, and no count over other documents."""
    rows = docs.withColumn("s", sentences(F.col("text")))
    return rows.select(
        "src_id", "doc_id", "title", "type", "text", F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("one_line"), F.slice("s", 1, 5).alias("key_points"),
        F.left("text", F.lit(1500)).alias("detailed_summary"), F.array().cast("array<struct<name:string,explanation:string>>").alias("concepts"),
    )
