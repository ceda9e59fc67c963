"""The driver's tables in the shapes of the engine: ballots, problems with gold answers, systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows for which there is a task of its own, and of which its sorts, windows and tallies hold several copies.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: str, most: int = TASK_ROWS) -> DataFrame:
    """rows by key, `most` a task on average, where there are more of them than the cores take at once.

    Otherwise a task gets as many rows as fit a number of compressed bytes, so that its memory grows with the table.
    """
    parts = -(-rows.count() // most)
    return rows.repartition(parts, key) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sampled answer: id, pos, ans (canonical integer text or null), logp, trunc, len, seed, system, score.

    pos counts from 0 in a total order of the line's columns, as line numbers repeat within an order.
    """
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("id"),
        pos.alias("pos"),
        F.when(F.col("l_linenumber") != 7, (F.col("l_partkey") % 5).cast("string")).alias("ans"),
        (-(F.col("l_discount") + F.col("l_tax"))).alias("logp"),
        (F.col("l_returnflag") == "R").alias("trunc"),
        (F.col("l_quantity") * 40).cast("int").alias("len"),
        (F.col("l_linenumber") % 3).alias("seed"),
        F.col("l_linestatus").alias("system"),
        F.col("l_tax").alias("score"),
        (F.col("l_suppkey") % 5).alias("other"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("string").alias("gold"), F.col("o_orderpriority").alias("category"))


BALLOTS_SQL = f"""b AS (SELECT l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1)::INT AS pos,
  CASE WHEN l_linenumber <> 7 THEN (l_partkey % 5)::VARCHAR END AS ans, -(l_discount + l_tax) AS logp, l_returnflag = 'R' AS trunc,
  trunc(l_quantity * 40)::INT AS len, l_linenumber % 3 AS seed, l_linestatus AS system, l_tax AS score, l_suppkey % 5 AS other FROM lineitem)"""
GOLD_SQL = "g AS (SELECT o_orderkey AS id, (o_custkey % 5)::VARCHAR AS gold, o_orderpriority AS category FROM orders)"
