"""State of sources over time: promotion, downgrade, staleness, rollback, recovery. State changes are tables, not files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Trust layers from the lowest on, and one step down from each state.
LAYERS = ("outputs", "wiki", "curated", "locked")
DOWN = {"promoted": "promoted_to_wiki", "promoted_to_wiki": "compiled", "compiled": "compiled"}
TARGET = {"wiki": ("compiled", "promoted_to_wiki", 85), "curated": ("promoted_to_wiki", "promoted", 90)}


def promoted(manifests: DataFrame, layer: str, least: int | None = None, limit: int | None = None) -> DataFrame:
    """src_id, quality_score, status, promoted_to of the sources that move up to a layer, best first."""
    before, after, score = TARGET[layer]
    rows = manifests.where((F.col("status") == before) & (F.col("quality_score") >= (score if least is None else least)))
    rows = rows.select("src_id", "quality_score", F.lit(after).alias("status"), F.lit(layer).alias("promoted_to"))
    return rows if limit is None else rows.orderBy(F.desc("quality_score"), "src_id").limit(limit)


def downgraded(manifests: DataFrame, least: int) -> DataFrame:
    """Promoted sources below a score, one step down, with the reason."""
    step = F.create_map(*(F.lit(x) for pair in DOWN.items() for x in pair))
    rows = manifests.where(F.col("status").isin("promoted", "promoted_to_wiki") & (F.col("quality_score") < least))
    return rows.select("src_id", F.col("status").alias("was"), F.element_at(step, F.col("status")).alias("status"), F.format_string("score %d < %d", F.col("quality_score"), F.lit(least)).alias("reason"))


def promoted_artifacts(moves: DataFrame, artifacts: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """moves (src_id, ...) with moved: whether the layer before has an artifact (src_id, layer, ...) of the source; and the rows that a move copies to the layer after."""
    own = artifacts.where(F.col("layer") == before)
    there = own.select("src_id").distinct().withColumn("moved", F.lit(True))
    rows = moves.join(there, "src_id", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    return rows, own.join(moves.select("src_id"), "src_id", "left_semi").withColumn("layer", F.lit(after))


def withdrawn(artifacts: DataFrame, downgrades: DataFrame) -> DataFrame:
    """artifacts (layer, stem) without those that a downgrade (title, layer) takes away: of that name, or of it and a number."""
    gone = downgrades.select("layer", F.col("title").alias("stem")).distinct()
    rows = artifacts.withColumn("__bare", F.regexp_replace("stem", r"_\d+$", ""))
    rows = rows.join(gone, ["layer", "stem"], "left_anti")
    return rows.join(gone.withColumnRenamed("stem", "__bare"), ["layer", "__bare"], "left_anti").select(*artifacts.columns)


def polluted(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artifacts (stem) that no promoted source's title accounts for, with or without a number after it."""
    titles = manifests.where(F.col("status").isin("promoted_to_wiki", "promoted")).select(F.col("title").alias("stem")).distinct()
    rows = artifacts.withColumn("bare", F.regexp_replace("stem", r"_\d+$", ""))
    rows = rows.join(titles, "stem", "left_anti")
    return rows.join(titles.withColumnRenamed("stem", "bare"), "bare", "left_anti").select(*artifacts.columns)


def fingerprint(config: dict) -> str:
    """16 digits that stand for a compile configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def staleness(rows: DataFrame, now: str) -> DataFrame:
    """rows (src_id, config) -> src_id, state: stale, up_to_date or no_config."""
    return rows.select("src_id", F.when(F.col("config").isNull(), "no_config").when(F.col("config") == now, "up_to_date").otherwise("stale").alias("state"))


def rolled_back(versions: DataFrame, drop: int = 10) -> DataFrame:
    """versions (src_id, version, score) -> each with the version that stays in force: one that loses more than `drop` is taken back."""
    order = Window.partitionBy("src_id").orderBy("version")
    rows = versions.withColumn("before", F.lag("score").over(order))
    return rows.withColumn("rolled_back", F.coalesce(F.col("before") - F.col("score") > drop, F.lit(False)))


def failure_streaks(batches: DataFrame, share: float = 0.5, most: int = 3) -> DataFrame:
    """batches (run, batch, success, failed) -> with the length of the streak of bad batches and whether the run stops there."""
    order = Window.partitionBy("run").orderBy("batch")
    bad = F.col("failed") > share * (F.col("success") + F.col("failed"))
    rows = batches.withColumns({"bad": bad, "good_before": F.sum((~bad).cast("int")).over(order)})
    streak = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("run", "good_before").orderBy("batch"))
    return rows.withColumn("streak", F.when(F.col("bad"), streak).otherwise(0).cast("int")).withColumn("stops", F.col("streak") >= most).drop("good_before")


def with_trust(chunks: DataFrame, trust: DataFrame) -> DataFrame:
    """chunks with the trust level of their source; low where it has none."""
    return chunks.join(trust.select("src_id", "trust_level"), "src_id", "left").withColumn("trust_level", F.coalesce("trust_level", F.lit("low")))
