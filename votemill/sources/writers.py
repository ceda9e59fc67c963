"""Sinks: JSON lines, CSV of answers or chosen columns, metrics, numbered chunks with their key apart, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votemill.operators.corpus import chunked
from votemill.operators.votes import fits_int64


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def answers_csv(df: DataFrame, path: str) -> None:
    """One CSV file id,answer. Answers that do not fit 64 bits are an error here: the rules replace them before."""
    fit = df.select("id", F.when(fits_int64(F.col("answer").cast("string")), F.col("answer").cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("answer too long for id "), F.col("id").cast("string")))).alias("answer"))
    fit.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def columns_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def metrics(spark: SparkSession, values: dict[str, float], path: str) -> None:
    spark.createDataFrame([(values,)], "metrics map<string,double>").select(F.to_json("metrics").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def chunks(df: DataFrame, path: str, key_path: str, size: int = 20) -> None:
    """Questions in numbered parts, `size` each, and their answers in another folder, so that no solver sees them."""
    rows = chunked(df, size)
    text = F.concat(F.lit("## ID: "), F.col("id").cast("string"), F.lit("\n"), F.col("question"), F.lit("\n"))
    rows.select("chunk", "place", text.alias("value")).orderBy("chunk", "place").select("chunk", "value").write.mode("overwrite").partitionBy("chunk").text(path)
    rows.select("chunk", "place", "id", "answer").write.mode("overwrite").option("header", True).csv(key_path)


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
