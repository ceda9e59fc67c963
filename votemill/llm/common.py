"""Shared helpers: table access, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many ids a list of ids is joined by shuffle instead of being broadcast (16 bytes an id).
BROADCAST_IDS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows and bytes of a batch that goes to a Python worker; texts are long, and Spark's own limit is 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def in_batches(df: DataFrame, function, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """df.mapInArrow with batches of bounded size, and with freed memory given back when a task ends."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Workers live on between tasks: what they have freed goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/votemill/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote and no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{scratch_dir(spark)}/votemill/".split(":", 1)[-1].lstrip("/") in path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df joined to ids on key. ids is broadcast only when it was counted to be small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of df with the smallest hashes of their key (n is a fixed bound).

    Each task of a top-n sends n rows, so rows that cannot be among them are left out first: those whose hash is
    above twice the share wanted.
    """
    spread = 1 << 40
    place = F.pmod(F.xxhash64(key), F.lit(spread))
    total = df.count()
    if total > 2 * n + 1000:
        df = df.filter(place < int(spread * (2 * n + 1000) / total))
    return df.orderBy(place, key).limit(n)
