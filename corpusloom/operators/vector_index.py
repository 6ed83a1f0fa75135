"""Approximate nearest neighbours: an inverted file of short codes, and whole vectors for the few that are close by their codes.

Centres are fitted on a bounded sample; every row is indexed: it goes to the list of its nearest
centre and gets a code of four bits a component, of its difference from that centre. A query probes the
nearest lists, by as many centres as the sample itself needs for the wanted recall: few where the
vectors have clusters, many where they have none. Codes of the probed lists are compared, and only the
`refine` closest of a query are tested on their whole vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import top_per
from corpusloom.sources.store import written

LEVELS = 16  # of a component's code


@dataclass
class Lists:
    """Centres, the scale of codes, and how many lists a query probes."""

    centres: np.ndarray
    scale: np.ndarray
    probe: int

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest centres of each row, the nearest first."""
        far = squared(rows, self.centres)
        n = min(n, far.shape[1])
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)

    def codes(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Two components a byte."""
        level = np.clip(np.floor((rows - self.centres[lists]) / self.scale + LEVELS / 2), 0, LEVELS - 1).astype(np.uint8)
        level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
        return level[:, ::2] * LEVELS + level[:, 1::2]

    def restored(self, codes: np.ndarray, number: int) -> np.ndarray:
        """About the rows that the codes of list `number` are of."""
        level = np.stack([codes // LEVELS, codes % LEVELS], 2).reshape(len(codes), -1)[:, : self.centres.shape[1]]
        return (level - LEVELS / 2 + 0.5) * self.scale + self.centres[number]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, v: vectors without a null or non-finite component."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(whole).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def fitted(rows: DataFrame, lists: int | None = None, most_sample: int = 20_000, rounds: int = 8, k: int = 5, recall: float = 0.95, seed: int = 7) -> Lists | None:
    """Lists from a sample of at most `most_sample` rows, chosen by a hash of their ids so that every row has the same chance.

    Without `lists` there are about the square root of all rows, and 8 sampled rows for each at least. `probe` is the
    least number of lists that hold `recall` of the k nearest neighbours of 200 sampled rows.
    """
    n = rows.count()
    if not n:
        return None
    share = min(1.0, 1.2 * most_sample / n)
    kept = rows if share == 1 else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.stack([r.v for r in kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_sample).collect()])
    count = lists or max(1, min(int(n**0.5), len(sample) // 8))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        own = squared(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        members = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(members > 0, sums / np.maximum(members, 1), centres)
    far = squared(sample, centres)
    own = far.argmin(1)
    spread = np.abs(sample - centres[own]).max(0)
    asked = rng.choice(len(sample), min(200, len(sample)), replace=False)
    pairs = squared(sample[asked], sample)
    pairs[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(pairs, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(far[asked], axis=1, kind="stable"), axis=1)  # of every list for each asked row
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    probe = int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1 if len(needed) else 1
    return Lists(centres, np.maximum(2 * spread / LEVELS, 1e-9), probe)


def indexed(rows: DataFrame, lists: Lists, ids: str = "long") -> DataFrame:
    """list, vec_id, code of every row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                own = lists.nearest(v, 1)[:, 0]
                codes = lists.codes(v, own)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "vec_id", "code"])

    return rows.mapInArrow(run, f"list int, vec_id {ids}, code binary")


def probed(rows: DataFrame, lists: Lists, ids: str = "long") -> DataFrame:
    """list, query_id, v: a row for every list that a query probes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                near = lists.nearest(v, lists.probe)
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column("vec_id").take(at), batch.column("v").take(at)], ["list", "query_id", "v"])

    return rows.mapInArrow(run, f"list int, query_id {ids}, v array<double>")


def close_by_code(asked: DataFrame, index: DataFrame, lists: Lists, refine: int, ids: str = "long", query_block: int = 1024, list_block: int = 16_384) -> DataFrame:
    """query_id, vec_id, about: the `refine` closest of each query by codes; a list of any size is dealt in blocks, and so are its queries."""
    sizes = index.groupBy("list").agg(F.count("*").alias("n"))
    met = asked.groupBy("list").agg(F.count("*").alias("q")).join(sizes, "list")
    blocks = met.select("list", F.expr(f"int((q + {query_block - 1}) div {query_block})").alias("nq"), F.expr(f"int((n + {list_block - 1}) div {list_block})").alias("nc"))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = asked.join(blocks, "list").select("list", "query_id", "v", deal("query_id", "nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"))
    right = index.join(blocks, "list").select("list", "vec_id", "code", deal("vec_id", "nc").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "about": []})
        codes = np.frombuffer(b"".join(c.code), np.uint8).reshape(len(c), -1)
        far = squared(np.stack(q.v), lists.restored(codes, int(c.list.iloc[0])))
        own = q.query_id.values[:, None] == c.vec_id.values[None, :]
        far[own] = np.inf
        n = min(refine, far.shape[1])
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        about = np.take_along_axis(far, some, 1).ravel()
        out = pd.DataFrame({"query_id": np.repeat(q.query_id.values, n), "vec_id": c.vec_id.values[some.ravel()], "about": about})
        return out[np.isfinite(about)]

    keys = ("list", "qb", "cb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {ids}, vec_id {ids}, about double")
    return top_per(found, "query_id", refine, F.col("about"), F.col("vec_id")).drop("rank")


def approximately_nearest(vectors: DataFrame, is_query: Column, k: int = 5, refine: int = 50, lists: Lists | None = None, ids: str = "long", **fit) -> DataFrame:
    """query_id, vec_id, distance, rank: nearest other vectors by squared L2; `refine` vectors a query are tested whole.

    Cases: vectors that are null, or hold a null or non-finite component, take no part; all vectors have the length of
    the first fitted one, others take no part; equal distances are ordered by id; an empty table gives an empty result.
    """
    rows = finite(vectors)
    lists = lists or fitted(rows.where(F.size("v") == _width(rows)), k=k, **fit)
    if lists is None:
        return rows.selectExpr("vec_id AS query_id", "vec_id", "0.0D AS distance", "1 AS rank").limit(0)
    rows = rows.where(F.size("v") == lists.centres.shape[1])
    index = written(indexed(rows, lists, ids), "index")
    asked = rows.where(is_query)
    close = close_by_code(probed(asked, lists, ids), index, lists, refine, ids)
    distance = F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    # Only those that are tested meet their vectors.
    tested = close.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(rows.select(F.col("vec_id").alias("vec_id"), "v"), "vec_id")
    found = top_per(tested.select("query_id", "vec_id", distance.alias("distance")), "query_id", k, F.col("distance"), F.col("vec_id"))
    return found.withColumn("distance", F.round("distance", 5))


def _width(rows: DataFrame) -> Column:
    """The most frequent length of a vector, the smallest of equals."""
    found = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return F.lit(found.w if found else 0)
