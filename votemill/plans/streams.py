"""Streams over the events table, which arrives in steps, drained into a committed sink; and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import runs
from votemill.plans.registry import query
from votemill.sources.adapters import table
from votemill.sources.scratch import work
from votemill.streaming import runs as streams
from votemill.streaming.completion import OUT, completed, completed_batch
from votemill.streaming.ingest import drain, ingest, put, sink_rows, todo

#: Steps in which the events arrive, about how many rows a file of a step has, and for how many there is a partition of state.
STEPS, FILE_ROWS, STATE_ROWS = 3, 1_000_000, 250_000


def arrivals(spark, events, home, close: bool = False):
    """The events as a stream of files: STEPS writes, one after the other in order of time, each read as one micro-batch.

    close: a last file with one row without a key, later than all, which moves the watermark past every timer and session.
    """
    place = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))")
    rows = events.withColumn("place_", place)
    cuts = [float("-inf"), *rows.approxQuantile("place_", [i / STEPS for i in range(1, STEPS)], 0.01), float("inf")]
    files = max(1, rows.count() // STEPS // FILE_ROWS)
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows.filter((F.col("place_") > a) & (F.col("place_") <= b)).drop("place_").repartition(files).write.mode("append").parquet(f"{home}/arrived")
    if close:
        last = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
        last.coalesce(1).write.mode("append").parquet(f"{home}/arrived")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/arrived")


def stream(spark, d, close: bool = False):
    """The stream, the same table, and the folder of the query's files."""
    events, home = table(spark, d, "events"), work(spark)
    return arrivals(spark, events, home, close), events, home


def parts(batch) -> int:
    return max(4, -(-batch.count() // STATE_ROWS))


@query("stream_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest(spark, d):
    events, batch, home = stream(spark, d)
    rows = events.select("event_id", "user_id", "event_type", "value")
    ingest(rows, f"{home}/sink", f"{home}/checkpoint", "event_id", parts(batch))
    return sink_rows(spark, f"{home}/sink", batch.select("event_id", "user_id", "event_type", "value").schema)


@query("stream_resume", "SELECT event_id, event_id % 7 <> 0 AS was_new FROM events")
def stream_resume(spark, d):
    """A stream over a sink that has some of its rows but no ledger: the rest is appended, nothing twice."""
    events, batch, home = stream(spark, d)
    put(batch.filter("event_id % 7 = 0").select("event_id", F.lit(False).alias("was_new")), f"{home}/sink")
    ingest(events.select("event_id", F.lit(True).alias("was_new")), f"{home}/sink", f"{home}/checkpoint", "event_id", parts(batch))
    found = sink_rows(spark, f"{home}/sink", "event_id long, was_new boolean")
    return found.unionByName(todo(batch.select("event_id"), found, "event_id").withColumn("was_new", F.lit(None).cast("boolean")))


#: A group is its first 60 rows.
GROUPS = """SELECT user_id AS key, count(*)::INT AS n, round(sum(value), 6) AS total, count(*) < 60 AS partial
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 60 GROUP BY user_id"""


@query("group_complete", GROUPS)
def group_complete(spark, d):
    return completed_batch(table(spark, d, "events"), "user_id", 60, order=("event_id",)).withColumn("total", F.round("total", 6))


@query("stream_group_complete", GROUPS)
def stream_group_complete(spark, d):
    """Complete groups as soon as they are; partial ones by their timers, when the last file moves the watermark."""
    events, batch, home = stream(spark, d, close=True)
    drain(completed(events, "user_id", 60, idle_ms=300 * 86_400_000, order=("event_id",)), f"{home}/sink", f"{home}/checkpoint", partitions=parts(batch))
    return sink_rows(spark, f"{home}/sink", OUT).filter("key IS NOT NULL").withColumn("total", F.round("total", 6))


STREAKS = """i AS (SELECT *, k - max(CASE WHEN event_type <> 'error' THEN k ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS streak
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events))"""
#: Errors in a row that a breaker bears.
LIMIT = 2


@query(
    "consecutive_failures",
    f"""WITH {STREAKS} SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, max(streak) AS longest,
 coalesce(min(k) FILTER (streak > {LIMIT}), count(*)) AS handled, arg_min(event_id, k) FILTER (streak > {LIMIT}) AS tripped_event_id FROM i GROUP BY user_id""",
)
def consecutive_failures(spark, d):
    """Each user's breaker, which opens at the third error in a row."""
    return runs.tripped(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", LIMIT).drop("tripped_ts")


@query("stream_consecutive_failures", f"WITH {STREAKS} SELECT user_id, min(k) AS handled, arg_min(event_id, k) AS tripped_event_id FROM i WHERE streak > {LIMIT} GROUP BY user_id")
def stream_consecutive_failures(spark, d):
    """The breakers that open, as the stream finds them."""
    events, batch, home = stream(spark, d)
    drain(streams.breakers(events, "user_id", F.col("event_type") == "error", LIMIT, order=("event_id",)), f"{home}/sink", f"{home}/checkpoint", partitions=parts(batch))
    return sink_rows(spark, f"{home}/sink", streams.TRIP).select(F.col("key").alias("user_id"), "handled", F.substring("place", 21, 20).cast("long").alias("tripped_event_id"))


SESSIONS = """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, false)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
 f AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, s),
 i AS (SELECT *, (epoch_us(coalesce(lead(started) OVER (PARTITION BY user_id ORDER BY started), (SELECT max(ts) FROM events))) - epoch_us(ended)) / 1000000.0::DOUBLE AS idle_s FROM f)
SELECT user_id, epoch_us(started) AS started_us, n, round(idle_s, 6) AS idle_s, idle_s >= 43200 AS tripped FROM i"""


def watched(found, events):
    """Sessions two hours apart with their idle time; twelve hours without a row trip the watchdog."""
    until = events.agg(F.max(F.col("ts").cast("timestamp")))
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(started AS timestamp_ntz))")
    return runs.idle(found, "user_id", "12 hours", until).select("user_id", start.alias("started_us"), "n", F.round("idle_s", 6).alias("idle_s"), "tripped")


@query("idle_sessions", SESSIONS)
def idle_sessions(spark, d):
    events = table(spark, d, "events")
    return watched(runs.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "2 hours"), events)


@query("stream_idle_sessions", SESSIONS)
def stream_idle_sessions(spark, d):
    """The same from a stream: a session is appended when the watermark has passed its gap."""
    events, batch, home = stream(spark, d, close=True)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    drain(runs.sessions(timed, "user_id", "ts", "2 hours"), f"{home}/sink", f"{home}/checkpoint", partitions=parts(batch))
    return watched(sink_rows(spark, f"{home}/sink", "user_id long, started timestamp, ended timestamp, n long").filter("user_id IS NOT NULL"), batch)


DISTINCT = """WITH f AS (SELECT event_type, user_id, min(ROW(ts, event_id)) AS at_ FROM events GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY at_) AS k FROM f)
SELECT event_type, count(*) AS n_distinct, max(CASE WHEN k = 12 THEN at_.event_id END) AS reached_event_id FROM (SELECT event_type, k, struct_pack(ts := at_[1], event_id := at_[2]) AS at_ FROM k) GROUP BY event_type"""


@query("distinct_target", DISTINCT)
def distinct_target(spark, d):
    """For each type the event with which the twelfth distinct user came."""
    return runs.reached(table(spark, d, "events"), "event_type", "user_id", ["ts", "event_id"], 12).drop("reached_ts")


@query("stream_distinct_target", DISTINCT)
def stream_distinct_target(spark, d):
    """The same from a stream, whose state knows the users that came; only first rows are written and numbered."""
    events, batch, home = stream(spark, d)
    drain(streams.first_seen(events, "event_type", "user_id", order=("event_id",)), f"{home}/sink", f"{home}/checkpoint", partitions=parts(batch))
    first = sink_rows(spark, f"{home}/sink", "group string, key long, place string").withColumnRenamed("group", "event_type")
    return runs.reached(first, "event_type", "key", ["place"], 12).select("event_type", "n_distinct", F.substring("reached_place", 21, 20).cast("long").alias("reached_event_id"))
