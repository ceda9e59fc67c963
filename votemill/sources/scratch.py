"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, or in the warehouse where none is set. A path without a scheme is one of Hadoop's default file system."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a written table: later reads see the same rows, whatever becomes of executors."""
    path = work(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
