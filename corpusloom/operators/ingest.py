"""The ingest job as a whole: files against what is known, ids that continue, an outcome for every file, committed by run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.manifest import numbered, with_sequential_ids
from corpusloom.sources import bucketed
from corpusloom.sources.store import written

KNOWN = "content_hash string, name string, unique_name string, seq long, src_id string, path string, category string, size_bytes long"


def ingest(files: DataFrame, store: str, run: int) -> DataFrame:
    """files (path, name, category, size_bytes, content_hash) -> path, category, outcome, seq, src_id, unique_name; the new ones are put into the store `store` under the run.

    Outcomes: skipped (a kind that is not taken in), failed (empty), known (an earlier run has the
    content), repeated (a file before it by path has), linked. Ids continue from the greatest of earlier
    runs; a name that is taken gets the number of files that have it as suffix. A run that is repeated
    compares itself with earlier runs alone, so it gives and commits the same rows.
    Cases: null categories and sizes are skipped and failed; paths tell files apart; no files, no rows.
    """
    spark = files.sparkSession
    earlier = bucketed.before(spark, store, run, KNOWN)
    usable = F.col("category").isNotNull() & (F.coalesce("size_bytes", F.lit(0)) > 0)
    good = files.where(usable)
    # The store stays where it is: only the files' hashes are shuffled to its buckets.
    unknown = good.select("path", "content_hash").join(earlier.select("content_hash"), "content_hash", "left_anti")
    first = written(unknown.groupBy("content_hash").agg(F.min("path").alias("path")), "new-files")
    new = good.join(first.select("path"), "path")
    held = earlier.agg(F.max("seq").alias("last"))
    last = held.first().last or 0
    ids = with_sequential_ids(new.select("path"), "path", last + 1)
    taken = earlier.join(new.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("taken"))
    names = numbered(new.select("path", "name"), ["name"], ["path"], "n").join(taken, "name", "left")
    k = F.col("n") - 1 + F.coalesce("taken", F.lit(0))
    names = names.select("path", F.when(k == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), k.cast("string"))).alias("unique_name"))
    linked = new.join(ids, "path").join(names, "path").withColumn("src_id", F.format_string("SRC-%04d", "seq"))
    linked = written(linked.select(*(c.split()[0] for c in KNOWN.split(", "))), "linked")
    bucketed.put(linked, store, "content_hash", run)
    repeated = unknown.join(first.select(F.col("path").alias("of")), F.col("path") == F.col("of"), "left_anti").select("path", F.lit("repeated").alias("told"))
    told = linked.select("path", F.lit("linked").alias("told"), "seq", "src_id", "unique_name").unionByName(repeated, allowMissingColumns=True)
    bad = F.when(F.col("category").isNull(), "skipped").when(~usable, "failed")
    return files.join(told, "path", "left").select("path", "category", F.coalesce(bad, "told", F.lit("known")).alias("outcome"), "seq", "src_id", "unique_name")


def statistics(outcomes: DataFrame, by: str = "category") -> DataFrame:
    """by, total, and a count for each outcome."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("linked", "known", "repeated", "skipped", "failed")]
    return outcomes.groupBy(by).agg(F.count("*").alias("total"), *counts)
