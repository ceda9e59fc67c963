"""Running numbers and sums over a total order, without taking a large table to one task.

Up to ONE_TASK rows a window does. Beyond that, cut points from a bounded sample deal the rows into ranges of the order;
each range numbers and sums its own rows, and the ranges' totals (a row a range) shift them to their place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.sources.scratch import written

ONE_TASK, SAMPLE, RANGES, RANGE_ROWS = 1_000_000, 10_000, 256, 250_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], number: str = "k", most: int = ONE_TASK, sample: int = SAMPLE, ranges: int | None = None) -> DataFrame:
    """df with each row's number in the order (from 1) and the sums up to it. The order must tell all rows apart.

    df is worked out once and written; what follows reads it. There are RANGES ranges, or more if
    these had over RANGE_ROWS rows, unless the caller says how many.
    """
    rows = written(df.select("*", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("at_"), *[v.alias(f"{k}_own_") for k, v in sums.items()]))
    n = rows.count()
    if n <= most:
        return numbered(rows, [], sums, number, order).drop("at_", *[f"{k}_own_" for k in sums])
    ranges = ranges or max(RANGES, -(-n // RANGE_ROWS))
    share = int(min(1.0, sample / n) * (1 << 30))
    picked = sorted(tuple(r[0]) for r in rows.filter(F.pmod(F.xxhash64("at_"), F.lit(1 << 30)) < share).select("at_").collect())
    cuts = [picked[i * len(picked) // ranges] for i in range(1, ranges)] if picked else []
    rows = rows.withColumn("part_", passed(cuts, rows.schema["at_"].dataType, F.col("at_")))
    ends = rows.groupBy("part_").agg(F.count("*").alias("n_"), *[F.sum(f"{k}_own_").alias(f"{k}_all_") for k in sums])
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = ends.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n_"), *[F.coalesce(F.sum(f"{k}_all_").over(before), F.lit(0)).alias(f"{k}_all_") for k in sums])
    moved = numbered(rows.repartition(ranges, "part_"), ["part_"], sums, number, order).join(F.broadcast(shift), "part_")
    return moved.select(*df.columns, (F.col(number) + F.col("n_")).alias(number), *[(F.col(k) + F.col(f"{k}_all_")).alias(k) for k in sums])


def passed(cuts: list[tuple], kinds, at: Column) -> Column:
    """How many of the sorted cuts are not above `at`: first by every stride-th of them, then by those of one stride."""
    if not cuts:
        return F.lit(0)
    stride = math.isqrt(len(cuts)) + 1
    array = lambda some: F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kinds)]) for c in some])
    upto = lambda edge: F.size(F.filter(edge, lambda c: c <= at))
    coarse = upto(array(cuts[stride - 1 :: stride])) * stride if len(cuts) >= stride else F.lit(0)
    return coarse + upto(F.slice(array(cuts), coarse + 1, F.lit(stride)))


def numbered(rows: DataFrame, keys: list[str], sums: dict[str, Column], number: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("at_")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.row_number().over(w).cast("long").alias(number), *[F.sum(f"{k}_own_").over(upto).alias(k) for k in sums])


def hash_ranks(df: DataFrame, draw: Column, keys: tuple[str, ...], tie: str, number: str = "r_", total: str = "n_") -> DataFrame:
    """df with each row's rank in its group by a hexadecimal digest, and the group's size.

    Ranges of the digest (its first two digits, evenly filled) are ranked by themselves and shifted by the counts before.
    """
    rows = df.withColumn("h_", draw).withColumn("b_", F.substring("h_", 1, 2))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_g_")) for k in keys]
    sizes = rows.groupBy(*keys, "b_").agg(F.count("*").alias("m_"))
    w = Window.partitionBy(*keys)
    sizes = sizes.select(*[F.col(k).alias(f"{k}_g_") for k in keys], F.col("b_").alias("b_g_"), F.coalesce(F.sum("m_").over(w.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("m_").over(w).alias(total))
    ranked = rows.withColumn("own_", F.row_number().over(Window.partitionBy(*keys, "b_").orderBy("h_", tie)))
    on = F.col("b_") == F.col("b_g_")
    for s in same:
        on = on & s
    return ranked.join(sizes, on).select(*df.columns, (F.col("own_") + F.col("before_")).alias(number), total)
