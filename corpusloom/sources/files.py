"""Files in and out: folders of documents, manifests, evaluation sets, model responses."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.manifest import category

MANIFEST = (
    "id string, title string, type string, source_path string, file_path string, content_hash string, date_ingested string, date_published string, size_bytes long, "
    "status string, quality_score int, error_message string, promoted_to string, tags array<string>, trust_level string, _bad string"
)
SAMPLE = "id string, question string, expected_source_ids array<string>, ground_truth string, tags array<string>, metadata map<string,string>"


def scan(spark: SparkSession, path: str, most_bytes: int = 500 << 20) -> DataFrame:
    """path, name, category, size_bytes, content_hash, content of the files under a folder; skipped kinds, empty and too large files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    name = F.element_at(F.split("path", "/"), -1)
    kind = category(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return rows.select("path", name.alias("name"), kind.alias("category"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), "content").where("category IS NOT NULL")


def vault(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, text of the Markdown files under a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select("_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def manifests(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """Manifests, one JSON object a line; lines that are none are skipped."""
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")
    return rows if status is None else rows.where(F.col("status") == status)


def write_index(rows: DataFrame, path: str) -> None:
    """The flat index as CSV with a header."""
    rows.select("id", "title", "type", "file_path", "content_hash", "date_ingested", "status", "quality_score").write.mode("overwrite").option("header", "true").csv(path)


def eval_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from JSON lines; blank lines, comments and rows without id or question are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.from_json("value", SAMPLE).alias("x")).select("x.*").where("id IS NOT NULL AND question IS NOT NULL")


def write_samples(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_layers(rows: DataFrame, path: str) -> None:
    """Artifacts, a folder for each trust layer."""
    rows.write.mode("overwrite").partitionBy("layer").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Operation records (ts, ...), a folder for each day, added to what is there."""
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def recent(rows: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows that are not older than so many days."""
    return rows.where(F.col(ts) >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))


def _object(text: str | None) -> str | None:
    """The first JSON object inside a text: from a brace to the one that closes it, braces in strings not counted.

    One pass finds the pairs of braces. Where an outer pair is no object, inner ones are tried, but
    none that holds the place at which parsing failed before. An object nested deeper than the parser
    follows is not a response to use.
    """
    starts, quoted, escaped, pairs = [], False, False, []
    for i, c in enumerate(text or ""):
        if quoted and starts:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and starts:
            quoted = True
        elif c == "{":
            starts.append(i)
        elif c == "}" and starts:
            pairs.append((starts.pop(), i + 1))
    failed, decoder = -1, json.JSONDecoder()
    for a, b in sorted(pairs):
        if a < failed < b:
            continue
        try:
            if decoder.raw_decode(text, a)[1] == b:
                return text[a:b]
        except json.JSONDecodeError as e:
            failed = e.pos
        except RecursionError:
            return None
    return None


def first_objects(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> id, json: the first balanced object in a model's response, null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(_object, batch.column("text").to_pylist()), pa.string())], ["id", "json"])

    return rows.select("id", "text").mapInArrow(run, "id long, json string")


def write_report(rows: DataFrame, path: str, most_failures: int = 10) -> None:
    """An evaluation report: every row as JSON, and the first failures (rows with misses) as Markdown; the limit is the report's feature."""
    rows.write.mode("overwrite").json(f"{path}/results")
    bad = rows.where(F.size("missed") > 0).orderBy("query_id").limit(most_failures)
    bad.select(F.concat(F.lit("- "), F.col("query_id").cast("string"), F.lit(": "), F.array_join("missed", ", ")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/failures")


def write_progress(manifests: DataFrame, path: str) -> None:
    """A progress report as JSON: a row for each status with its share, and one with the scores of all; there are as many rows as states."""
    scored = F.when(F.col("quality_score") > 0, F.col("quality_score"))
    total = manifests.agg(F.count("*").alias("total"), F.round(F.avg(scored), 1).alias("average"), F.max(scored).alias("max"), F.min(scored).alias("min"), F.count(scored).alias("samples"), F.round(100.0 * F.count_if(F.expr("status = 'compiled'")) / F.count("*"), 1).alias("compiled_percentage"))
    by_status = manifests.groupBy("status").agg(F.count("*").alias("count")).crossJoin(F.broadcast(total.select("total")))
    rows = by_status.select("status", "count", F.round(100.0 * F.col("count") / F.col("total"), 1).alias("percentage"))
    both = rows.unionByName(total.withColumn("status", F.lit("all")), allowMissingColumns=True).withColumn("timestamp", F.current_timestamp())
    both.coalesce(1).write.mode("overwrite").json(path)


def without_failed(manifests: DataFrame) -> DataFrame:
    """Manifests of sources that have not failed."""
    return manifests.where(F.col("status") != "failed")
