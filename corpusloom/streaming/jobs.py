"""Structured Streaming jobs, and a way to drain one over what its files hold now.

Every job's state is bounded: windows and sessions close at the watermark and are written once, repeats
are looked for as long as the watermark allows and older ones in the store, and what is kept for a key
leaves when its event-time timer fires.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.sources.store import new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTENTS = "content_hash string, doc_id long"


def file_stream(spark: SparkSession, sf_dir: str, name: str, arrived: bool = False) -> DataFrame:
    """The table's Parquet files as a stream; with `arrived`, the time at which a row's file came."""
    path = f"{sf_dir}/{name}.parquet"
    # A pattern, as a stream takes a folder or a pattern, not one file.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows.withColumn("arrived", F.col("_metadata.file_modification_time")) if arrived else rows


def timed(events: DataFrame, late: str) -> DataFrame:
    """events whose rows may come up to `late` after newer ones; ts may be of either timestamp type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, event_type, n for each hour, once it has closed; rows of hours that had closed when the batch before theirs ran are dropped. In complete mode: every hour, open ones too, and no row is dropped."""
    rows = timed(events, late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def error_rates(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, errors, n for windows of two hours, each an hour after the last, once they have closed."""
    rows = timed(events, late).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"))
    return rows.agg(F.count_if(F.expr("event_type = 'error'")).alias("errors"), F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "errors", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, errors of each session, once it has closed: events of a user with less than `gap` between them."""
    rows = timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.expr("event_type = 'error'")).alias("errors"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "errors")


def first_contents(documents: DataFrame, late: str = "10 minutes") -> DataFrame:
    """content_hash, doc_id of documents (doc_id, text, arrived): contents that have not come within the watermark; older repeats are the store's to find."""
    rows = documents.select(F.sha2("text", 256).alias("content_hash"), "doc_id", "arrived").withWatermark("arrived", late)
    return rows.dropDuplicatesWithinWatermark(["content_hash"]).select("content_hash", "doc_id")


def into_store(store: str) -> Callable[[DataFrame, int], None]:
    """A sink that adds to the folder `store` the contents that no earlier batch has brought.

    A batch has a folder of its own, and is compared with those of smaller ids alone, so one that is
    run again writes the same rows in the same place.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(store)
        is_there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        rows = batch.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
        if is_there:
            rows = rows.join(stored(spark, store).where(F.col("batch") < batch_id).select("content_hash"), "content_hash", "left_anti")
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return put


def stored(spark: SparkSession, store: str) -> DataFrame:
    """content_hash, doc_id, batch of everything in the store."""
    return spark.read.schema(f"{CONTENTS}, batch long").option("basePath", store).parquet(store)


def ingest(documents: DataFrame, store: str, checkpoint: str, late: str = "10 minutes") -> Drained:
    """Take in all documents (doc_id, text, arrived) that there are now; a later call with the same folders goes on from there."""
    return _run(first_contents(documents, late), "append", checkpoint, into_store(store))


def failure_stops(batches: DataFrame, share: float = 0.5, most: int = 3, idle: str = "3 days", late: str = "1 day") -> DataFrame:
    """batches (run, batch, at, success, failed), in order -> run, batch, streak, stops, closed.

    streak is the length of the streak of bad batches up to a batch; a run stops at `most`. A run
    without a batch for `idle` is closed once: a row without a batch, with its last streak; its state goes.
    """
    wait = _milliseconds(idle)

    class Streaks(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.streak = handle, handle.getValueState("streak", "n int, last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n, last = self.streak.get() if self.streak.exists() else (0, None)
            before = last
            for part in rows:
                out = []
                for r in part.sort_values("batch").itertuples():
                    n = n + 1 if r.failed > share * (r.success + r.failed) else 0
                    last = max(last or 0, int(pd.Timestamp(r.at).timestamp() * 1000))
                    out.append((key[0], r.batch, n, n >= most, False))
                yield _frame(out)
            _wait_until(self.handle, before, last, wait)
            self.streak.update((n, last))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            n, _ = self.streak.get()
            self.streak.clear()
            yield _frame([(key[0], None, n, n >= most, True)])

        def close(self) -> None:
            pass

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["run", "batch", "streak", "stops", "closed"]).astype({"batch": "Int64"})

    return batches.withWatermark("at", late).groupBy("run").transformWithStateInPandas(Streaks(), "run long, batch long, streak int, stops boolean, closed boolean", "Append", "EventTime")


def tracked(events: DataFrame, idle: str = "7 days", late: str = "1 hour") -> DataFrame:
    """src_id, opened, successes, failures after each batch.

    The counts of a source that has had no news for `idle` leave the state; they are in the rows
    written so far, and later news open a new entry, told apart by `opened` (see last_state).
    """
    wait = _milliseconds(idle)

    class Counts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.counts = handle, handle.getValueState("counts", "opened long, good long, bad long, last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            opened, good, bad, last = self.counts.get() if self.counts.exists() else (None, 0, 0, None)
            before = last
            for part in rows:
                bad += int((part.event_type == "error").sum())
                good += int((part.event_type != "error").sum())
                last = max(last or 0, int(part.ts.max().timestamp() * 1000))
                opened = opened if opened is not None else int(part.ts.min().timestamp() * 1000)
            _wait_until(self.handle, before, last, wait)
            self.counts.update((opened, good, bad, last))
            yield pd.DataFrame({"src_id": [key[0]], "opened": [opened], "successes": [good], "failures": [bad]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.counts.clear()
            return iter(())

        def close(self) -> None:
            pass

    rows = timed(events, late).select("user_id", "event_type", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Counts(), "src_id long, opened long, successes long, failures long", "Update", "EventTime")


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _wait_until(handle: StatefulProcessorHandle, before: int | None, last: int, wait: int) -> None:
    """One timer a key, `wait` after its last event."""
    if before != last:
        if before is not None:
            handle.deleteTimer(before + wait)
        handle.registerTimer(last + wait)


def last_state(updates: DataFrame) -> DataFrame:
    """src_id, successes, failures, state: the last update of each entry, a source's entries together; a failure does not overwrite a success."""
    entries = updates.groupBy("src_id", "opened").agg(F.max("successes").alias("successes"), F.max("failures").alias("failures"))
    rows = entries.groupBy("src_id").agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))
    return rows.withColumn("state", F.when(F.col("successes") > 0, "compiled").otherwise("failed"))


@dataclass
class Drained:
    """What a stream wrote, what it left out as late (counted after a first aggregation), and the rows of state after each batch."""

    rows: DataFrame | None
    late: int
    states: list[int]


def _run(stream: DataFrame, mode: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> Drained:
    """Run a stream over all there is, with state in RocksDB."""
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.numRecentProgressUpdates": "100000"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    told = [p.stateOperators for p in query.recentProgress]
    return Drained(None, sum(o.numRowsDroppedByWatermark for p in told for o in p), [sum(o.numRowsTotal for o in p) for p in told])


def replayed(stream: DataFrame, mode: str) -> Drained:
    """Run a stream over all files there are.

    Each batch has a folder of its own, by its id, so a batch that is run again replaces what it
    wrote. In complete mode the last batch is the result; in update and append mode all batches are.
    """
    out, last = new_path(stream.sparkSession, "stream"), []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        last.append(batch_id)

    done = _run(stream, mode, f"{out}/checkpoint", put)
    spark = stream.sparkSession
    if not last:
        done.rows = spark.createDataFrame([], stream.schema)
        return done
    done.rows = spark.read.schema(stream.schema).parquet(f"{out}/rows/batch={max(last)}" if mode == "complete" else f"{out}/rows/*")
    return done


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream writes over all files there are."""
    return replayed(stream, mode).rows
