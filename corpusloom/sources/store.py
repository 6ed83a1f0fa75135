"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder.

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
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: what is read twice is worked out once, and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version_of(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files under paths: another version of a table has another value."""
    found = []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame], *inputs: str) -> DataFrame:
    """The table that build gives, written the first time that this application asks for the name, and again when the files under `inputs` have changed."""
    key, version = (spark.sparkContext.applicationId, name), version_of(spark, *inputs)
    if key not in _made or _made[key][0] != version:
        _made[key] = (version, written(build(), "shared"))
    return _made[key][1]


def forget(spark: SparkSession) -> None:
    """Drop what `once` knows of this application; the next asker builds anew."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
