"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own.

    Where neither is set, a session on one machine (tests) gets a temporary folder; on a cluster that
    would scatter the files over the executors' own disks, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="spark-corpusloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has yet; inside `scratch`, in the folder that goes at its end."""
    folder = _folders[-1] if _folders else f"{shared_dir(spark)}/corpusloom"
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside go when the block ends; write the result elsewhere before that."""
    _folders.append(f"{shared_dir(spark)}/corpusloom/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        removed(spark, _folders.pop())


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind when it ends; without it they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it (--py-files does so on a cluster)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def small_batches(spark: SparkSession, rows: int = 2000, most_bytes: int = 16 << 20) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes, so that a Python worker's memory stays bounded by its longest text.

    Lowers two settings of the session, which hold when a plan is made, so they stay lowered.
    """
    find_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone (a null text becomes empty), whatever other columns docs has."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row; inside a higher-order function it would be once an element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def identified(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) as row (all their columns), id, no_id and body: what tells one row's decision from another's.

    body is a digest of the text of 128 bits, so rows with one doc_id, or with none, are told apart by
    their texts, and rows that repeat both have the same decision. Joins on the three are plain
    equalities, and spread rows without an id by their texts. Whatever rows' columns are called, they
    are inside `row`.
    """
    key = rows["doc_id"].cast("long")
    return rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"), F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("no_id"), body_of(rows["text"]).alias("body"))


IDENTITY = ["id", "no_id", "body"]


def body_of(text: Column) -> Column:
    """Digest of a text; a null text has one of its own."""
    return F.unhex(F.coalesce(F.md5(text), F.lit("00")))


#: SQL: `crc`, the unsigned crc32 (h) of every doc_id as text; DuckDB has no such function.
SQL_CRC = """tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(i))),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab)"""
