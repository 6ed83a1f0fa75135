"""Streams over files that come in a given order, against the batch jobs."""

import os
import time

from pyspark.sql import functions as F

from corpusloom.operators import lifecycle as L
from corpusloom.operators import ops as O
from corpusloom.plans import ops_queries
from corpusloom.streaming import jobs as J

EVENTS = "/root/testdata/sf0.001/events.parquet"


def arriving(spark, path, frames, apart=0):
    """A stream that takes one file a batch, in the order of the frames; with `apart`, files come so many seconds after each other."""
    now = time.time() - apart * len(frames)
    for i, df in enumerate(frames):
        at = f"{path}/f{i:03}"
        df.coalesce(1).write.parquet(at)
        for name in os.listdir(at):
            if name.startswith("part-"):
                os.utime(f"{at}/{name}", (now + i * max(apart, 1), now + i * max(apart, 1)))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def events(spark):
    return spark.read.parquet(EVENTS)


def late_by_file(frames, window_end, late=3600):
    """Rows of each frame (lists) whose window had closed when the batch before theirs ran: Spark drops by the watermark of that batch."""
    marks, dropped = [float("-inf")] * 2, []
    for rows in frames:
        dropped += [r for r in rows if window_end(r) <= marks[-2]]
        marks.append(max([marks[-1], *(r.ts.timestamp() - late for r in rows)]))
    return dropped


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = events(spark)
    frames = [rows.where("event_id % 10 < 4"), rows.where("event_id % 10 BETWEEN 4 AND 8"), rows.where("event_id % 10 = 9")]
    hour = lambda r: r.ts.replace(minute=0, second=0, microsecond=0)
    dropped = late_by_file([f.collect() for f in frames], lambda r: hour(r).timestamp() + 3600)
    done = J.replayed(J.hourly_counts(arriving(spark, tmp_path / "e", frames)), "append")
    gone, want, last = {r.event_id for r in dropped}, {}, max(r.ts for r in rows.collect())
    for r in rows.collect():
        if r.event_id not in gone and hour(r).timestamp() + 3600 <= last.timestamp() - 3600:
            want[hour(r), r.event_type] = want.get((hour(r), r.event_type), 0) + 1
    assert {(r.start, r.event_type): r.n for r in done.rows.collect()} == want
    assert dropped and done.late == len({(hour(r), r.event_type) for r in dropped})  # counted after a first aggregation of the file


def test_sessions_as_in_a_batch(spark, tmp_path):
    rows = events(spark).cache()
    frames = [rows.where(f"event_id % 13 <> 0 AND ts >= timestamp_ntz'{a}' AND ts < timestamp_ntz'{b}'") for a, b in (("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-20"), ("2024-01-20", "2024-02-10"))]
    frames.insert(2, rows.where("event_id % 13 = 0 AND ts < timestamp_ntz'2024-01-20'"))  # a file with old rows, most of them late
    done = J.replayed(J.sessions(arriving(spark, tmp_path / "e", frames)), "append")
    dropped = {r.event_id for r in late_by_file([f.collect() for f in frames], lambda r: r.ts.timestamp() + 1800)}
    used = rows.where("event_id % 13 <> 0 OR ts < timestamp_ntz'2024-01-20'")
    want = O.sessions(used.where(~F.col("event_id").isin([*dropped]))).collect()
    mark = max(r.ts for r in used.collect()).timestamp() - 3600
    closed = sorted((r.user_id, r.start, r.end, r.n, r.errors) for r in want if r.end.timestamp() <= mark)
    assert dropped and done.late > 0 and sorted((r.user_id, r.start, r.end, r.n, r.errors) for r in done.rows.collect()) == closed
    assert done.states[-1] <= len(want) - len(closed)


def test_ingest_keeps_its_state_small_and_can_be_replayed(spark, tmp_path):
    texts = [[f"t{i}" for i in range(20 * b, 20 * b + 20)] + [f"t{i}" for i in range(0, 20 * b, 7)] + ["t0", "t1"] for b in range(8)]
    frames = [spark.createDataFrame([(100 * b + i, t) for i, t in enumerate(x)], "doc_id long, text string") for b, x in enumerate(texts)]
    arriving(spark, tmp_path / "d", frames, apart=3600)
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/d/*").withColumn("arrived", F.col("_metadata.file_modification_time"))
    store = str(tmp_path / "store")
    done = J.ingest(stream(), store, str(tmp_path / "check"))
    held = sorted((r.content_hash, r.doc_id, r.batch) for r in J.stored(spark, store).collect())
    assert len({h for h, _, _ in held}) == len(held) == 160
    assert max(done.states[2:]) <= 2 * max(map(len, texts)) < 160  # what has passed the watermark has left
    again = J.ingest(stream(), store, str(tmp_path / "check"))  # nothing new
    assert again.states == [] or max(again.states) < 160
    J.into_store(store)(frames[3].select(F.sha2("text", 256).alias("content_hash"), "doc_id"), max(b for _, _, b in held if b <= 3))  # a batch that is run again
    J.ingest(stream(), store, str(tmp_path / "other"))  # all of it again, from the beginning
    assert sorted((r.content_hash, r.batch) for r in J.stored(spark, store).collect()) == sorted((h, b) for h, _, b in held)


def test_streaks_in_a_stream_as_in_a_batch(spark, tmp_path):
    rows = [(r, b, 1 + (r + b) % 3, (5 * b + r) % 7) for r in range(4) for b in range(12) if r or b < 4]
    batches = spark.createDataFrame(rows, "run long, batch long, success long, failed long").withColumn("at", F.timestamp_seconds((F.col("batch") + 19_000) * 86400))
    frames = [batches.where(f"batch BETWEEN {a} AND {b}") for a, b in ((0, 3), (4, 6), (7, 9), (10, 11))]
    done = J.replayed(J.failure_stops(arriving(spark, tmp_path / "b", frames)), "append")
    got = done.rows.collect()
    want = {(r.run, r.batch, r.streak, r.stops) for r in L.failure_streaks(batches.drop("at")).collect()}
    assert {(r.run, r.batch, r.streak, r.stops) for r in got if not r.closed} == want and sum(not r.closed for r in got) == len(want)
    last = {r.run: r.streak for r in sorted(L.failure_streaks(batches.drop("at")).collect(), key=lambda r: r.batch)}
    assert [(r.run, r.batch, r.streak) for r in got if r.closed] == [(0, None, last[0])]  # run 0 had no news, and is closed once


def test_state_of_idle_sources_goes(spark, tmp_path):
    at = lambda day: F.expr(f"timestamp'2024-01-{day:02} 00:00:00'")
    kinds = F.when(F.col("id") % 3 == 0, "error").otherwise("view")
    first = spark.range(60).select((F.col("id") % 20).alias("user_id"), kinds.alias("event_type"), at(1).alias("ts"))
    mids = [spark.range(2).select((F.col("id") + 100).alias("user_id"), F.lit("error").alias("event_type"), at(d).alias("ts")) for d in (12, 14)]
    back = spark.range(1).select(F.lit(3).cast("long").alias("user_id"), F.lit("error").alias("event_type"), at(20).alias("ts"))
    done = J.replayed(J.tracked(arriving(spark, tmp_path / "e", [first, *mids, back])), "update")
    got = {r.src_id: (r.successes, r.failures, r.state) for r in J.last_state(done.rows).collect()}
    every = [r for f in (first, *mids, back) for r in f.collect()]
    for u in {r.user_id for r in every}:
        bad = sum(r.event_type == "error" for r in every if r.user_id == u)
        good = sum(r.event_type != "error" for r in every if r.user_id == u)
        assert got[u] == (good, bad, "compiled" if good else "failed")
    assert max(done.states) >= 20 and done.states[-1] < max(done.states) / 2


def test_hourly_counts_of_the_query_are_whole(spark, tmp_path):
    """Rows that come late and hours that are open at the end count too."""
    rows = events(spark)
    (tmp_path / "events.parquet").mkdir()
    for i, part in enumerate((rows.where("event_id % 3 = 0"), rows.where("event_id % 3 = 1"), rows.where("event_id % 3 = 2"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        for name in os.listdir(f"{tmp_path}/w{i}"):
            if name.startswith("part-"):
                os.link(f"{tmp_path}/w{i}/{name}", f"{tmp_path}/events.parquet/{i}-{name}")
    got = ops_queries.stream_hourly_counts(spark, str(tmp_path)).collect()
    want = rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").count().collect()
    assert {(r.start, r.event_type, r.n) for r in got} == {tuple(r) for r in want} and len(got) == len(want)
