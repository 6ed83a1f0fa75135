"""Tables that grow by runs and are met by one key: written in buckets of it, so that a join or a grouping by the key leaves them where they are.

A run has a partition of its own, and one that is repeated replaces its rows. A store's name is that of a
catalogue table; its files are in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.store import new_path, removed


def put(rows: DataFrame, name: str, key: str, run: int, buckets: int = 16) -> None:
    """Add the rows of a run to the store, which is made if it is not there."""
    spark = rows.sparkSession
    rows = rows.repartition(buckets, key).withColumn("run", F.lit(run).cast("long"))
    if spark.catalog.tableExists(name):
        key_of_mode = "spark.sql.sources.partitionOverwriteMode"  # an insert reads it from the session alone
        mode = spark.conf.get(key_of_mode)
        spark.conf.set(key_of_mode, "dynamic")
        try:
            rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set(key_of_mode, mode)
    else:
        _made(rows, name, key, buckets)


def _made(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    path = new_path(rows.sparkSession, name.replace(".", "-"))
    rows.write.format("parquet").option("path", path).partitionBy("run").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def before(spark: SparkSession, name: str, run: int, schema: str) -> DataFrame:
    """What runs of smaller numbers have put there; without a store, an empty table of the schema."""
    return spark.table(name).where(F.col("run") < run) if spark.catalog.tableExists(name) else spark.createDataFrame([], f"{schema}, run long")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that is last in `order`, by run, then by all it holds."""
    rest = [c for c in rows.columns if c not in (key, order, "run")]
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("run"), *(F.desc(c) for c in rest)))
    return rows.withColumn("__r", last).where("__r = 1").drop("__r")


def compact(spark: SparkSession, name: str, key: str, order: str, buckets: int = 16) -> None:
    """Keep the latest row of each key alone; readers of the old files must be done."""
    old = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
    rows = latest(spark.table(name), key, order)
    fresh = f"{name}_compacted"
    spark.sql(f"DROP TABLE IF EXISTS {fresh}")
    _made(rows.repartition(buckets, key), fresh, key, buckets)
    drop(spark, name, old)
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


def drop(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Take a store away, files and all."""
    if not spark.catalog.tableExists(name):
        return
    location = location or spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
    spark.sql(f"DROP TABLE {name}")
    removed(spark, location)
