"""Failures in a row, sessions, distinct targets and groups, in tables and streams, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from votemill.operators import runs
from votemill.streaming import completion, ingest
from votemill.streaming import runs as streams

ROW = "user long, at long, failed boolean"


def random_rows(seed, n=1500):
    """A third of the rows belong to one user, some to none."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, *range(2, 8), None]), i, rng.random() < 0.6) for i in range(n)]
    return rows + [(9, n + i, True) for i in range(200)] + [(10, n + 300, False)]


def plain_streaks(rows):
    out, state = {}, {}
    for user, at, failed in sorted(rows, key=lambda r: r[1]):
        k, streak = state.get(user, (0, 0))
        state[user] = (k + 1, streak + 1 if failed else 0)
        out[(user, at)] = state[user]
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_streaks_over_ranges(spark, parts):
    rows = random_rows(parts)
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), ROW)
    got = runs.streaks(df, "user", ["at"], F.col("failed"), parts)
    want = plain_streaks(rows)
    assert {(r["user"], r["at"]): (r["k"], r["streak"]) for r in got.collect()} == want
    assert {(r["user"], r["at"]): r["n"] for r in runs.numbered(df, ["user"], ["at"], "n", parts).collect()} == {x: v[0] for x, v in want.items()}


def test_hot_user_lies_in_many_ranges(spark):
    df = spark.createDataFrame([(1, i, i % 5 != 0) for i in range(4000)], ROW)
    sizes = [r["count"] for r in runs.ranged(df, ["user"], ["at"], 8).groupBy("part_").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


@pytest.mark.parametrize("limit", [0, 4, 300])
def test_breaker(spark, limit):
    rows = random_rows(3)
    want = {}
    for user, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1])), key=lambda r: r[0]):
        own, streaks = list(own), []
        for r in own:
            streaks.append((streaks[-1] if streaks else 0) + 1 if r[2] else 0)
        trip = next((i for i, s in enumerate(streaks) if s > limit), None)
        want[user] = (len(own), sum(r[2] for r in own), max(streaks), len(own) if trip is None else trip + 1, None if trip is None else own[trip][1])
    got = {r[0]: tuple(r)[1:] for r in runs.tripped(spark.createDataFrame(rows, ROW), "user", ["at"], F.col("failed"), limit, 9).collect()}
    assert got == want


def test_null_failures_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, None), (1, 2, True)], ROW)
    assert [r["streak"] for r in runs.streaks(df, "user", ["at"], F.col("failed"), 3).orderBy("at").collect()] == [1, 0, 1]
    assert runs.tripped(df.limit(0), "user", ["at"], F.col("failed")).count() == 0


def test_sessions_and_idle_time(spark):
    minutes = {1: [0, 5, 9, 40, 41, 200], 2: [7], None: [3, 100]}
    rows = [(u, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00") for u, ms in minutes.items() for m in ms * 2]
    df = spark.createDataFrame(rows, "user long, at string").select("user", F.to_timestamp("at").alias("at"))
    got = runs.idle(runs.sessions(df, "user", "at", "20 minutes"), "user", "1 hour", df.agg(F.max("at")))
    minute = lambda t: t.hour * 60 + t.minute
    assert sorted(((r["user"], minute(r["started"]), minute(r["ended"]), r["n"], r["idle_s"] / 60, r["tripped"]) for r in got.collect()), key=str) == sorted(
        [(1, 0, 9, 6, 31, False), (1, 40, 41, 4, 159, True), (1, 200, 200, 2, 0, False), (2, 7, 7, 2, 193, True), (None, 3, 3, 2, 97, True), (None, 100, 100, 2, 100, True)], key=str
    )


def test_distinct_target(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.choice([*range(60), None]), i) for i in range(900)]
    seen, want = {}, {}
    for g, k, at in rows:
        if k is not None and k not in seen.setdefault(g, set()):
            seen[g].add(k)
            if len(seen[g]) == 50:
                want[g] = at
    got = {r["g"]: (r["n_distinct"], r["reached_at"]) for r in runs.reached(spark.createDataFrame(rows, "g string, k long, at long"), "g", "k", ["at"], 50, 6).collect()}
    assert got == {g: (len(s), want.get(g)) for g, s in seen.items()}


EVENT = "user long, value double, id long, ts timestamp"


class Source:
    """A folder into which events are put step by step, and the stream over it."""

    def __init__(self, spark, home):
        self.spark, self.home = spark, home
        (home / "in").mkdir()
        self.stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(home / "in"))

    def put(self, rows):
        df = self.spark.createDataFrame([(u, v, i, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00") for u, v, i, m in rows], "user long, value double, id long, ts string")
        df.coalesce(1).write.mode("append").json(str(self.home / "in"))

    def drain(self, rows, schema, before=None, name="sink"):
        query = ingest.drain(rows, str(self.home / name), str(self.home / f"{name}-checkpoint"), before)
        return ingest.sink_rows(self.spark, str(self.home / name), schema), query


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path)


def test_groups_over_micro_batches(source):
    """The first n rows of a group, wherever batches part them; partial groups come from timers alone, once."""
    for a, b in ((0, 20), (20, 45), (45, 60)):
        source.put([(u, float(m), m * 10 + u, m) for m in range(a, b) for u in ((1, 2, 3) if m % 10 == 0 else (1,)) if not (u == 3 and m > 10)])
    out = completion.completed(source.stream, "user", 5, delay="1 minute", idle_ms=25 * 60_000, order=("id",))
    got, query = source.drain(out, completion.OUT)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert {(r["key"], r["n"], r["total"], r["partial"]) for r in got.collect()} == {(1, 5, 10.0, False), (2, 5, 100.0, False), (3, 2, 10.0, True)}
    assert got.count() == 3
    source.put([(6, 1.0, 8000, 300)])
    source.put([(u, 1.0, 9000 + u, 400) for u in (1, 2, 3, 4)])  # the watermark has passed their timers: all keys begin anew
    source.put([(7, 1.0, 1, 1000)])
    got, _ = source.drain(out, completion.OUT)
    assert sorted((r["key"], r["n"]) for r in got.collect() if r["n"] == 1) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 1)]
    assert got.count() == 8


def test_batch_is_replayed_after_a_kill(source):
    """A batch whose rows were written but not committed comes again and counts once; state goes on from the batch before."""
    for a in (0, 10, 20):
        source.put([(u, 1.0, m, m) for m in range(a, a + 10) for u in (1, 2)])
    out = completion.completed(source.stream, "user", 15, delay="1 minute", idle_ms=10**9, order=("id",))
    batches = []

    def die(batch, run):
        batches.append(batch.count())
        if len(batches) == 2:
            batch.write.mode("overwrite").parquet(f"{source.home}/sink/run_={run}/batch_=1")
            raise RuntimeError("killed")
        return batch

    with pytest.raises(Exception, match="killed"):
        source.drain(out, completion.OUT, die)
    assert ingest.sink_rows(source.spark, str(source.home / "sink"), completion.OUT).count() == 0
    got, _ = source.drain(out, completion.OUT, die)
    assert sorted((r["key"], r["n"], r["total"]) for r in got.collect()) == [(1, 15, 15.0), (2, 15, 15.0)]
    assert batches[1] == batches[2] == 2
    committed = ingest.committed(source.spark, str(source.home / "sink"))
    assert committed.select("batch_").distinct().count() == committed.count() >= 3 and committed.agg(F.sum("rows")).first()[0] == 2


def test_completed_batch_is_the_stream(source):
    rng = random.Random(5)
    rows = [(rng.randint(1, 9), float(i % 7), i, i // 3) for i in range(300)]
    for a in range(0, 300, 100):
        source.put(rows[a : a + 100])
    source.put([(None, 0.0, 0, 1400)])
    got, _ = source.drain(completion.completed(source.stream, "user", 35, idle_ms=10**7, order=("id",)), completion.OUT)
    table = source.spark.read.schema(EVENT).json(str(source.home / "in")).filter("user IS NOT NULL")
    want = completion.completed_batch(table, "user", 35, order=("id",))
    assert sorted(map(tuple, got.filter("key IS NOT NULL").collect())) == sorted(map(tuple, want.collect()))


def test_breakers_and_first_rows_of_streams(source):
    rng = random.Random(6)
    rows = [(rng.randint(1, 5), float(rng.random() < 0.6), i, i // 4) for i in range(240)]
    for a in range(0, 240, 80):
        source.put(rows[a : a + 80])
    table = source.spark.read.schema(EVENT).json(str(source.home / "in"))
    got, _ = source.drain(streams.breakers(source.stream, "user", F.col("value") > 0, 3, order=("id",)), streams.TRIP)
    want = runs.tripped(table, "user", ["ts", "id"], F.col("value") > 0, 3).filter("tripped_id IS NOT NULL")
    assert sorted((r["key"], r["handled"], int(r["place"][20:])) for r in got.collect()) == sorted((r["user"], r["handled"], r["tripped_id"]) for r in want.collect())
    schema = "group string, key long, place string"
    got, _ = source.drain(streams.first_seen(source.stream.withColumn("g", (F.col("id") % 2).cast("string")), "g", "user", order=("id",)), schema, name="first")
    first = {}
    for u, _, i, _ in rows:
        first.setdefault((str(i % 2), u), i)
    assert {(r["group"], r["key"]): int(r["place"][20:]) for r in got.collect()} == first


def test_ingest_reads_no_sink_and_heals(source):
    for a in (0, 10, 5):
        source.put([(1, 1.0, i, i) for i in range(a, a + 10)])
    run = lambda c: ingest.ingest(source.stream, str(source.home / "sink"), str(source.home / c), "id")
    ids = lambda: sorted(r["id"] for r in ingest.sink_rows(source.spark, str(source.home / "sink"), EVENT).collect())
    run("c1")
    assert ids() == list(range(20))
    run("c2")  # the ledger is lost
    assert ids() == list(range(20))
    source.put([(1, 1.0, i, i) for i in range(15, 25)])
    run("c1")
    run("c2")
    assert ids() == list(range(25))
