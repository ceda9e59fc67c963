"""Rows of a key in order: numbers, failures in a row, idle sessions, the row at which a distinct count is reached.

Rows are dealt into ranges of (key, order), so that a key with many rows lies in many ranges. A range works on its own rows; what a key
brings along from the ranges before is a row for each (range, key), and only the first key of a range can have any: these
are no more rows than ranges, and are broadcast. The order must tell the rows of a key apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.sources.scratch import written

#: Pre-merging of sessions before the exchange, so that a user with many rows sends its sessions only.
MERGE_EARLY = "spark.sql.sessionWindow.merge.sessions.in.local.partition"


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The written rows with part_ (their range), k_ (number within range and key), in as many ranges as shuffle partitions."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *keys, *order).withColumn("part_", F.spark_partition_id()))
    return dealt.withColumn("k_", F.row_number().over(Window.partitionBy("part_", *keys).orderBy(*order)))


def with_before(rows: DataFrame, keys: list[str], before: DataFrame) -> DataFrame:
    """rows and the columns of before (part_, keys and more), which has rows for keys that lie in several ranges only."""
    other = before.select(F.col("part_").alias("part_b_"), *[F.col(k).alias(f"{k}_b_") for k in keys], *[c for c in before.columns if c not in ("part_", *keys)])
    on = F.col("part_") == F.col("part_b_")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_b_"))
    return rows.join(F.broadcast(other), on, "left").drop("part_b_", *[f"{k}_b_" for k in keys])  # a row a range at most


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "k", parts: int | None = None) -> DataFrame:
    """rows with their number (from 1) within their keys."""
    dealt = ranged(rows, keys, order, parts)
    earlier = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # ranges of a key
    before = dealt.groupBy("part_", *keys).agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(earlier)).filter("before_ > 0")
    return with_before(dealt, keys, before.select("part_", *keys, "before_")).select(*rows.columns, (F.col("k_") + F.coalesce("before_", F.lit(0))).cast("long").alias(name))


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column, parts: int | None = None) -> DataFrame:
    """rows with k (number within the key), failed, and streak: the failures in a row up to the row, 0 at a success.

    A range's summary of a key is its length n and its tail, the failures that it ends with; where tail = n, the streak goes on
    from the ranges before, so summaries add up from the last one that had a success.
    """
    dealt = ranged(rows.withColumn("failed", F.coalesce(failed, F.lit(False))), [key], order, parts)
    upto = Window.partitionBy("part_", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("good_", F.max(F.when(~F.col("failed"), F.col("k_"))).over(upto))
    sums = dealt.groupBy("part_", key).agg(F.count("*").alias("n_"), (F.count("*") - F.coalesce(F.max(F.when(~F.col("failed"), F.col("k_"))), F.lit(0))).alias("tail_"))
    by = Window.partitionBy(key).orderBy("part_")  # ranges of a key
    sums = sums.withColumn("broken_", F.sum((F.col("tail_") < F.col("n_")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("end_", F.sum("tail_").over(Window.partitionBy(key, "broken_").orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)))
    before = sums.select("part_", key, F.lag("end_", 1, 0).over(by).alias("streak_"), F.sum("n_").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before_")).filter("before_ > 0")
    streak = F.when(F.col("good_").isNull(), F.col("k_") + F.coalesce("streak_", F.lit(0))).otherwise(F.col("k_") - F.col("good_"))
    return with_before(dealt, [key], before).select(*rows.columns, (F.col("k_") + F.coalesce("before_", F.lit(0))).cast("long").alias("k"), "failed", streak.cast("long").alias("streak"))


def tripped(rows: DataFrame, key: str, order: list[str], failed: Column, limit: int = 4, parts: int | None = None) -> DataFrame:
    """Per key a breaker that opens when more than `limit` failures stand in a row: n, failures, longest run, handled (rows up to
    the one that opens it, all if none does), and the order columns of that row, null if it stays closed."""
    at = F.min(F.when(F.col("streak") > limit, F.struct("k", *order)))
    out = streaks(rows, key, order, failed, parts).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"), F.max("streak").alias("longest"), at.alias("at_"))
    return out.select(key, "n", "failures", "longest", F.coalesce("at_.k", "n").alias("handled"), *[F.col(f"at_.{c}").alias(f"tripped_{c}") for c in order])


def sessions(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Per key its sessions, parted by `gap` or more without a row: started, ended (the last row's time) and n rows.

    Works on tables and, with a watermark on `time`, on streams. Early merging sends sessions, not rows, to their key's task.
    """
    rows.sparkSession.conf.set(MERGE_EARLY, "true")
    found = rows.groupBy(key, F.session_window(time, gap).alias("w_")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w_.start").alias("started"), (F.col("w_.end") - F.expr(f"INTERVAL {gap}")).alias("ended"), "n")


def idle(found: DataFrame, key: str, limit: str, until: DataFrame) -> DataFrame:
    """Sessions with idle_s, the seconds until the key's next session (or until the one time of `until`), and whether those reach `limit`."""
    following = F.lead("started").over(Window.partitionBy(key).orderBy("started"))  # sessions of a key
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    rows = found.join(F.broadcast(until.toDF("until_"))).withColumn("idle_s", seconds(F.coalesce(following, "until_"), F.col("ended")))  # one row
    return rows.withColumn("tripped", F.col("idle_s") >= F.expr(f"(unix_micros(until_ + INTERVAL {limit}) - unix_micros(until_)) / 1e6")).drop("until_")


def reached(rows: DataFrame, group: str, key: str, order: list[str], target: int, parts: int | None = None) -> DataFrame:
    """Per group: n_distinct keys, and the order columns of the row at which the target-th distinct key first came; null if it never did."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(group, key).agg(F.min(F.struct(*order)).alias("at_")).select(group, key, "at_.*")
    place = numbered(first, [group], order, "k_th_", parts)
    out = place.groupBy(group).agg(F.max("k_th_").alias("n_distinct"), F.min(F.when(F.col("k_th_") == target, F.struct(*order))).alias("at_"))
    return out.select(group, "n_distinct", *[F.col(f"at_.{c}").alias(f"reached_{c}") for c in order])
