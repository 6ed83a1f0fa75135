"""Exact top-k search by a three-phase uniform threshold.

The vectors' components are dealt to `nodes` groups of columns; a node knows the partial inner
products of its columns alone. Phase 1 gathers from every node each query's highest partial scores
and works out the full scores of the vectors met there; the k-th best of these is a score that the
answer cannot fall below. Phase 2 sends every node that cutoff divided by the number of nodes: a
vector below it at every node is below the cutoff in sum, whatever the signs, so the entries at or
above it hold the whole answer. Phase 3 adds up what is known and resolves the rest exactly.

Vectors meet queries in blocks of bounded size, each block pair in a task of its own; no task, and
not the driver, holds a whole list. Equal vectors are one candidate with its k + 1 smallest ids (no
other can be in an answer) and equal queries are asked once, so copies do not multiply the work.

Components x count as floor(256 * x). Cases: a vector that is null, or holds a null or non-finite
component, or has a null id, takes no part; shorter vectors count as filled up with zeros; ties go
to the smaller id; a query with fewer than k other vectors gets them all; rows that repeat an id are
each a candidate; empty tables give an empty result; other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import find_package, written

SCALE = 256


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the components' whole numbers as little-endian 64-bit integers."""
    find_package(table.sparkSession)
    x = F.transform(table[vector_col], lambda c: c.cast("double"))
    rows = table.select(table[id_col].cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat = np.floor(SCALE * np.asarray(x.flatten(), np.float64)).astype("<i8").tobytes()
            at = (8 * (np.asarray(x.offsets) - x.offsets[0].as_py())).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id long, v binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T, in floating point only where that is exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53:
        return q.astype(np.float64) @ c.T.astype(np.float64)
    return q @ c.T


def _exact(pairs: DataFrame, queries: DataFrame, distinct: DataFrame) -> DataFrame:
    """qid, cid, score of pairs (qid, cid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = (_matrix(batch.column(x).to_pylist()) for x in ("qv", "cv"))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("cid"), pa.array((q * c).sum(axis=1))], ["qid", "cid", "score"])

    met = pairs.join(distinct.select("cid", F.col("v").alias("cv")), "cid").join(queries.select("qid", F.col("v").alias("qv")), "qid")
    return met.select("qid", "cid", "qv", "cv").mapInArrow(run, "qid long, cid long, score long")


def top_k(table: DataFrame, is_query: Column, k: int = 5, nodes: int = 2, query_block: int = 1024, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row the k best other rows of table (vec_id, embedding)."""
    base = written(quantised(table), "vectors")
    asked = base.where(is_query)
    width = base.agg(F.max(F.length("v"))).first()[0] or 8
    width = -(-width // (8 * nodes)) * 8 * nodes  # bytes; each node's share is whole
    filled = F.rpad("v", width, F.lit(b"\0")).alias("v")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = base.select("vec_id", filled).withColumn("r", first).where(F.col("r") <= k + 1)
    distinct = written(distinct.groupBy("v").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "candidates")
    members = asked.select(F.col("vec_id").alias("query_id"), filled)
    queries = written(members.groupBy("v").agg(F.min("query_id").alias("qid")), "queries")
    members = members.join(queries, "v").select("query_id", "qid")
    share = width // nodes
    q_blocks, c_blocks = (max(1, -(-t.count() // size)) for t, size in ((queries, query_block), (distinct, candidate_block)))

    def dealt(rows: DataFrame, name: str, own: int, other: int, *more: str) -> DataFrame:
        """Each node's columns of every row, once for every block of the other side."""
        slices = F.array(*(F.struct(F.lit(j).alias("node"), F.substring("v", 1 + j * share, share).alias("part")) for j in range(nodes)))
        here, there = ("q", "c") if name == "qid" else ("c", "q")
        rows = rows.select(name, *more, F.pmod(F.xxhash64(name), F.lit(own)).cast("int").alias(here), F.explode(slices).alias("s"), F.lit(other).alias("n"))
        return rows.select(name, *more, here, "s.node", "s.part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(there))

    candidates = dealt(distinct, "cid", c_blocks, q_blocks)
    keys = ("node", "q", "c")

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"node": [], "qid": [], "cid": [], "part": []})
        scores, n = _products(_matrix(q.part), _matrix(c.part)), min(k + 1, len(c))
        at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return pd.DataFrame({"node": q.node.iloc[0], "qid": np.repeat(q.qid.values, n), "cid": c.cid.values[at.ravel()], "part": np.take_along_axis(scores, at, 1).ravel().astype(np.int64)})

    # Phase 1: local lists, the full scores of what is in them, and each query's safe cutoff.
    local = dealt(queries, "qid", q_blocks, c_blocks).groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(best, "node int, qid long, cid long, part long")
    place = F.row_number().over(Window.partitionBy("node", "qid").orderBy(F.desc("part"), "cid"))
    seeds = local.withColumn("r", place).where(F.col("r") <= k + 1).select("qid", "cid").distinct()
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    cutoff = _exact(seeds, queries, distinct).withColumn("r", order).where(F.col("r") == k + 1).select("qid", F.col("score").alias("cutoff"))
    # Without k + 1 candidates there is no cutoff: every entry is above the lowest number.
    informed = queries.join(cutoff, "qid", "left").withColumns({"open": F.col("cutoff").isNull(), "cutoff": F.coalesce("cutoff", F.lit(-(1 << 62)))})
    informed = written(informed, "cutoffs")

    def enough(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"qid": [], "cid": [], "part": []})
        # In whole numbers: a node's share of the cutoff, rounded up, is no more than what one of the nodes must reach.
        scores, least = _products(_matrix(q.part), _matrix(c.part)), -(-q.cutoff.values // nodes)
        i, j = np.nonzero(scores >= least[:, None])
        return pd.DataFrame({"qid": q.qid.values[i], "cid": c.cid.values[j], "part": scores[i, j].astype(np.int64)})

    # Phase 2: entries at or above the cutoff's share; known sums.
    entries = dealt(informed, "qid", q_blocks, c_blocks, "cutoff").groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(enough, "qid long, cid long, part long")
    known = written(entries.groupBy("qid", "cid").agg(F.sum("part").alias("score"), F.count("*").alias("n")), "known")
    # Phase 3: the rest, exactly.
    whole = known.where(F.col("n") == nodes).select("qid", "cid", "score")
    full = whole.union(_exact(known.where(F.col("n") < nodes).select("qid", "cid"), queries, distinct))
    full = full.join(informed.select("qid", "open", "cutoff"), "qid").where("open OR score >= cutoff")
    listed = full.join(distinct.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    # A query's own row goes once, even where its id repeats.
    own = F.row_number().over(Window.partitionBy("query_id", "copy", "vec_id").orderBy("r"))
    copies = members.groupBy("query_id", "qid").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    answer = copies.join(listed, "qid").withColumn("own", own).where((F.col("vec_id") != F.col("query_id")) | (F.col("own") > 1))
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50 the 5 best others: query_id, rank, vec_id, score."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
