"""The recovery job: failed sources tried again, each step a table, every try an attempt of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import rewrite_terms
from corpusloom.operators import quality as Q
from corpusloom.operators import state as T
from corpusloom.operators.compile import compile_job, extractive
from corpusloom.operators.manifest import risky_word
from corpusloom.plugins import Registry
from corpusloom.sources import bucketed

ATTEMPT = "src_id string, attempt long, method string, outcome string, status string, quality_score int, error_message string"


def texts(failed: DataFrame, converted: DataFrame, recognised: DataFrame, risky: list[str], rewrites: dict[str, str], least: int) -> DataFrame:
    """failed with method, new_text and reason: titles with a risky word are left out, the text is chosen, and rewritten where the model refused it."""
    word = risky_word(F.col("title"), risky) if risky else F.lit(None).cast("string")
    rows = failed.withColumn("risky", word)
    chosen = T.chosen_text(rows.where("risky IS NULL"), converted, recognised, least).withColumnRenamed("text", "new_text")
    rows = rows.join(chosen, "src_id", "left")
    refused = F.col("error_message").contains("llm_failed") & F.col("new_text").isNotNull()
    method = F.when(F.col("risky").isNotNull(), "skipped").when(refused & (F.col("method") == "original"), "sanitised").otherwise(F.col("method"))
    return rows.withColumns({"method": method, "new_text": F.when(refused, rewrite_terms(F.col("new_text"), rewrites)).otherwise(F.col("new_text")), "reason": F.when(F.col("risky").isNotNull(), "risky_title").otherwise(F.col("reason"))})


def recover(manifests: DataFrame, converted: DataFrame, recognised: DataFrame, store: str, attempt: int, mode: str = "all", risky: list[str] | None = None, rewrites: dict[str, str] | None = None, least: int = 100, least_points: int = 1, compiler: Callable[[DataFrame], DataFrame] = extractive, plugins: Registry | None = None) -> DataFrame:
    """One attempt for every failed source that `mode` selects and no earlier attempt has recovered: src_id, attempt, method, outcome, status, quality_score, error_message, put into the store `store`.

    manifests (src_id, doc_id, title, type, text, status, error_message), converted and recognised
    (src_id, text). Outcomes: recovered (compiled, with its score), failed (no text, or fewer key points
    than `least_points`), skipped (a risky title). An attempt that is repeated gives and commits the
    same rows, since it looks at earlier ones alone.
    """
    spark = manifests.sparkSession
    done = bucketed.before(spark, store, attempt, ATTEMPT).where("outcome = 'recovered'")
    failed = T.recoverable(manifests, mode).join(done.select("src_id"), "src_id", "left_anti")
    rows = texts(failed, converted, recognised, risky or [], rewrites or {}, least)
    docs = rows.where("new_text IS NOT NULL").select("src_id", "doc_id", "title", "type", F.col("new_text").alias("text"))
    compiled = Q.scored(compile_job(docs, plugins or Registry(), compiler), plugins or Registry())
    compiled = compiled.select("src_id", "quality_score", (F.size("key_points") >= least_points).alias("good"))
    met = rows.select("src_id", "method", "reason").join(compiled, "src_id", "left")
    good = F.coalesce("good", F.lit(False))
    outcome = F.when(F.col("method") == "skipped", "skipped").when(good, "recovered").otherwise("failed")
    error = F.when(good, None).when(F.col("reason").isNotNull(), F.col("reason")).otherwise("llm_failed: empty key points")
    told = met.select("src_id", F.lit(attempt).cast("long").alias("attempt"), "method", outcome.alias("outcome"), F.when(good, "compiled").otherwise("failed").alias("status"), F.when(good, F.col("quality_score")).otherwise(0).cast("int").alias("quality_score"), error.alias("error_message"))
    bucketed.put(told, store, "src_id", attempt)
    return spark.table(store).where(F.col("run") == attempt).drop("run")


def restated(manifests: DataFrame, store: str) -> DataFrame:
    """manifests with what all attempts came to: the first that recovered a source, else the last one's error; skipped sources stay as they are."""
    spark = manifests.sparkSession
    tries = spark.table(store).where("outcome <> 'skipped'")
    seq = F.when(F.col("outcome") == "recovered", F.lit(1 << 32) - F.col("attempt")).otherwise(F.col("attempt"))
    # A failure leaves what is compiled as it is; it may only replace an error.
    return T.restated(manifests, tries.select("src_id", seq.alias("seq"), "status", "quality_score", "error_message"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """method, outcome, n."""
    return attempts.groupBy("method", "outcome").agg(F.count("*").alias("n"))
