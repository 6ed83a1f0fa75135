"""Queries over usage, cost, alerts, sessions, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import ops as O
from corpusloom.plans.lifecycle_queries import BATCHES
from corpusloom.plans.registry import query, table
from corpusloom.sources.store import new_path
from corpusloom.streaming import jobs as J

_B = ", ".join(f"({b}::DOUBLE)" for b in O.BUCKETS)


@query(f"""WITH b(le) AS (VALUES {_B}), t AS (SELECT DISTINCT event_type FROM events) SELECT t.event_type, le, count(e.value) FILTER (e.value <= le) AS n FROM t, b JOIN events e ON true WHERE e.event_type = t.event_type GROUP BY 1, 2
UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY 1""")
def usage_histogram(spark, sf_dir):
    return O.histogram(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH p(name, place, price) AS (VALUES ('click', 0, 0.5::DOUBLE), ('v', 1, 0.25::DOUBLE), ('view', 2, 0.125::DOUBLE), ('sign', 3, 2.0::DOUBLE)), m AS (SELECT event_type AS model, arg_min(price, CASE WHEN event_type = name THEN 0 ELSE 1000 END + place) AS price
 FROM (SELECT DISTINCT event_type FROM events) JOIN p ON starts_with(event_type, name) GROUP BY 1) SELECT event_id, event_type AS model, round(CAST(round(value) AS BIGINT) / 1000 * price, 6) AS cost FROM events LEFT JOIN m ON model = event_type""")
def usage_cost(spark, sf_dir):
    prices = spark.createDataFrame([("click", 0, 0.5), ("v", 1, 0.25), ("view", 2, 0.125), ("sign", 3, 2.0)], "name string, place int, price double")
    usage = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.round("value").cast("long").alias("tokens"))
    return O.priced(usage, prices).select("event_id", "model", "cost")


@query("SELECT event_type, user_id % 10 AS team, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("team", F.col("user_id") % 10)
    return rows.rollup("event_type", "team").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH p(name, price) AS (VALUES ('click', 0.5::DOUBLE), ('view', 0.125::DOUBLE), ('signup', 2.0::DOUBLE)), c AS (SELECT event_type AS model, user_id % 10 AS team, CAST(round(value) AS BIGINT) AS tokens, round(CAST(round(value) AS BIGINT) / 1000 * price, 6) AS cost FROM events LEFT JOIN p ON event_type = name)
SELECT model, team, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM c GROUP BY ROLLUP (model, team)""")
def cost_rollup(spark, sf_dir):
    """Cost by kind of event and team, with subtotals."""
    prices = spark.createDataFrame([("click", 0, 0.5), ("view", 1, 0.125), ("signup", 2, 2.0)], "name string, place int, price double")
    usage = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("team"), F.round("value").cast("long").alias("tokens"))
    return O.rolled_up(O.priced(usage, prices), "model", "team")


@query("SELECT event_type, count(*) AS calls, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens, count(*) FILTER (value > 5) AS cache_hits, round(avg(value), 4) AS mean_value FROM events GROUP BY 1")
def usage_counters(spark, sf_dir):
    """Counters by kind of event; a value above 5 stands for an answer from the cache."""
    rows = table(spark, sf_dir, "events").select("event_type", F.round("value").cast("long").alias("tokens"), (F.col("value") > 5).alias("cache_hit"), "value")
    return O.counters(rows, "event_type")


@query("""WITH m AS (SELECT user_id AS scope, count(*) FILTER (event_type = 'error') / count(*) AS error_rate, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT scope, 'errors' AS alert FROM m WHERE error_rate > 0.25 UNION ALL SELECT scope, 'idle' FROM m WHERE n < 20 UNION ALL SELECT scope, 'costly' FROM m WHERE mean > 12""")
def alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scope"))
    rows = rows.agg((F.count_if(F.expr("event_type = 'error'")) / F.count("*")).alias("error_rate"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    return O.alerts(rows, {"errors": ("error_rate", 0.25, True), "idle": ("n", 20, False), "costly": ("mean", 12, True)})


SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, k"""


@query(SESSIONS)
def user_sessions(spark, sf_dir):
    return O.sessions(table(spark, sf_dir, "events"))


#: When the last batch of a stream of all events has passed, and how far its watermark of an hour is then.
PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT * FROM ({SESSIONS}) WHERE \"end\" <= {PASSED}")
def stream_sessions(spark, sf_dir):
    """Sessions of a stream that have closed."""
    return J.drained(J.sessions(J.file_stream(spark, sf_dir, "events")), "append")


@query("SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    """All tumbling windows, open ones too, over the events as a stream of files; the state is a row for each hour and kind of event."""
    return J.drained(J.hourly_counts(J.file_stream(spark, sf_dir, "events")), "complete")


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_ingest_dedup(spark, sf_dir):
    """Each content once in the store, over the documents as a stream of files, taken in twice."""
    store, checkpoint = new_path(spark, "store"), new_path(spark, "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        J.ingest(J.file_stream(spark, sf_dir, "documents", arrived=True), store, checkpoint)
    return J.stored(spark, store).select("content_hash")


@query(f"""WITH w AS (SELECT to_timestamp(0)::TIMESTAMP + INTERVAL 1 HOUR * (CAST(floor(epoch(ts) / 3600) AS BIGINT) - k) AS "start", event_type FROM events, (VALUES (0), (1)) AS t(k)) SELECT "start", count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM w GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0.3 * count(*) AND "start" + INTERVAL 2 HOUR <= {PASSED}""")
def stream_alert_rates(spark, sf_dir):
    """Sliding windows of two hours, once closed, with too many errors."""
    return J.drained(J.error_rates(J.file_stream(spark, sf_dir, "events")), "append").where("errors > 0.3 * n")


@query("""WITH e AS (SELECT *, date_trunc('hour', ts) AS "start", event_id % 7 = 0 AS late FROM events), one AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e WHERE event_id % 7 > 1), kept AS (SELECT e.* FROM e, one WHERE NOT late OR "start" + INTERVAL 1 HOUR > mark)
SELECT "start", event_type, count(*) AS n FROM kept GROUP BY 1, 2 HAVING "start" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_late_rows(spark, sf_dir):
    """The events in another order: every seventh comes after all others, and counts only where its hour is still open.

    Rows are dropped by the watermark that the batch before theirs ran with, so there is a batch between the first and the late one.
    """
    events = table(spark, sf_dir, "events")
    path = new_path(spark, "replay")
    for i, part in enumerate(("event_id % 7 > 1", "event_id % 7 = 1", "event_id % 7 = 0")):  # one file each, written one after the other
        events.where(part).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return J.drained(J.hourly_counts(stream), "append")


@query("SELECT user_id AS src_id, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'compiled' ELSE 'failed' END AS state FROM events GROUP BY 1")
def stream_state_machine(spark, sf_dir):
    """A state kept for every user across batches, by a stateful operator with a timer."""
    return J.last_state(J.drained(J.tracked(J.file_stream(spark, sf_dir, "events")), "update"))


@query(f"""WITH b AS (SELECT *, failed > 0.5 * (success + failed) AS bad FROM ({BATCHES})), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY batch) AS gb FROM b),
s AS (SELECT *, CASE WHEN bad THEN CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run, gb ORDER BY batch) AS INTEGER) ELSE 0 END AS streak FROM g),
l AS (SELECT run, arg_max(streak, batch) AS streak, max(batch) AS last FROM s GROUP BY run) SELECT run, batch, streak, streak >= 3 AS stops, false AS closed FROM s
UNION ALL SELECT run, NULL, streak, streak >= 3, true FROM l WHERE last + 3 <= (SELECT max(batch) - 1 FROM s)""")
def stream_failure_stops(spark, sf_dir):
    """Days of a user's events as batches of a run, with the streak of bad ones kept as state, and runs closed after three idle days."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), day.alias("at"))
    rows = rows.agg(F.count_if(F.expr("event_type <> 'error'")).alias("success"), F.count_if(F.expr("event_type = 'error'")).alias("failed"))
    rows = rows.withColumn("batch", F.floor(F.unix_timestamp("at") / 86400).cast("long"))
    path = new_path(spark, "batches")
    rows.repartition(1).write.parquet(path)  # one arrival: a run's days are in order inside it
    return J.drained(J.failure_stops(spark.readStream.schema(rows.schema).parquet(path)), "append")
