"""Usage, cost, alerts and sessions over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of latency buckets.
BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0)


def histogram(events: DataFrame, label: str, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """label, le, n: cumulative counts up to each bound; le is null for all."""
    counts = events.groupBy(label).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("all"))
    rows = F.array(*(F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return counts.select(label, F.inline(rows))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (id, model, tokens) with the price of its model: an exact name first, else the first price whose name begins it.

    Prices are a short list by nature, one row for each model that is sold.
    """
    match = F.when(F.col("model") == F.col("name"), 0).when(F.startswith(F.col("model"), F.col("name")), 1)
    models = usage.select("model").distinct().join(F.broadcast(prices), match.isNotNull())
    best = models.groupBy("model").agg(F.min_by("price", F.struct(match, F.col("place"))).alias("price"))
    return usage.join(best, "model", "left").withColumn("cost", F.round(F.col("tokens") / 1000 * F.col("price"), 6))


def rolled_up(costs: DataFrame, *by: str) -> DataFrame:
    """by, calls, tokens, cost with subtotals (null in what is summed over)."""
    return costs.rollup(*by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def counters(usage: DataFrame, *by: str) -> DataFrame:
    """by, calls, tokens, cache_hits, mean_value."""
    return usage.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count_if("cache_hit").alias("cache_hits"), F.round(F.avg("value"), 4).alias("mean_value"))


def alerts(metrics: DataFrame, rules: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """metrics (scope, columns) -> scope, alert: rules name a column, a bound, and whether above it is bad."""
    hits = F.array_compact(F.array(*(F.when(F.col(c) > b if above else F.col(c) < b, F.lit(name)) for name, (c, b, above) in rules.items())))
    return metrics.select("scope", F.explode(hits).alias("alert"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n, errors of runs of events without a longer gap."""
    window = F.session_window("ts", gap)
    rows = events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.expr("event_type = 'error'")).alias("errors"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")
