"""Resumable ingestion: micro-batches into an append-only sink, a parameter fingerprint, self-healing resume.

The stream's checkpoint is the ledger of what was read, and its state (in RocksDB, by key) of which keys came. A batch goes to a
folder of its own and then into a manifest of committed batches, by which the sink is read: a batch that is replayed after a
failure overwrites itself. No batch reads the sink, unless other runs have written to it: then their keys are left out, so a lost ledger heals itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FingerprintError(ValueError):
    """A run was resumed with other parameters."""


def check_fingerprint(spark: SparkSession, path: str, params: dict, force: bool = False) -> None:
    """Compare params with those the run began with (written at first), naming each that differs."""
    try:
        before = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = None
    if before is not None and not force:
        differ = sorted(k for k in {*before, *params} if before.get(k) != params.get(k))
        if differ:
            raise FingerprintError("; ".join(f"{k}: {before.get(k)!r} before, {params.get(k)!r} now" for k in differ))
    if before is None or force:
        spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Columns of a sink's folders: the stream that wrote a batch (the id in its checkpoint) and the batch's number.
RUN, BATCH = "run_", "batch_"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


PARTITIONS = "spark.sql.shuffle.partitions"


def manifest(sink: str) -> str:
    return f"{sink.rstrip('/')}-manifest"


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, sink: str) -> DataFrame:
    """run_, batch_ and rows of every committed batch."""
    return read_or_empty(spark, manifest(sink), f"rows long, {RUN} string, {BATCH} long")


def sink_rows(spark: SparkSession, sink: str, schema) -> DataFrame:
    """The rows of the sink's committed batches, with the columns of schema."""
    kinds = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = [c for c in kinds.fieldNames() if c not in (RUN, BATCH)]
    rows = read_or_empty(spark, sink, T.StructType([kinds[c] for c in names]).add(RUN, T.StringType()).add(BATCH, T.LongType()))
    return rows.join(F.broadcast(committed(spark, sink).select(RUN, BATCH)), [RUN, BATCH], "left_semi").select(*kinds.fieldNames())  # a row a batch


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint; streams of other checkpoints have others."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def commit(sink: str, checkpoint: str, before=None):
    """A foreachBatch function: a batch's rows go to a folder of its own, then its number into the manifest.

    A batch that comes again after a failure overwrites its folder; rows count once the manifest names their batch.
    before(batch, run): what is done to the batch's rows first.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, checkpoint)
        rows = before(batch, run) if before else batch
        rows.write.mode("overwrite").parquet(f"{sink}/{RUN}={run}/{BATCH}={number}")
        n = spark.read.schema(rows.schema).parquet(f"{sink}/{RUN}={run}/{BATCH}={number}").count()
        spark.range(1).select(F.lit(n).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{manifest(sink)}/{RUN}={run}/{BATCH}={number}")

    return write


def drain(rows: DataFrame, sink: str, checkpoint: str, before=None, mode: str = "append", partitions: int | None = None):
    """Write all that a stream's source has now into the sink, batch by batch; returns the ended query.

    partitions: of the state, fixed when the checkpoint begins (the session's shuffle partitions, if not given).
    """
    spark = rows.sparkSession
    spark.conf.set(*ROCKS)
    usual = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(partitions or usual))
    try:  # a stream keeps the settings that it starts with
        query = rows.writeStream.foreachBatch(commit(sink, checkpoint, before)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PARTITIONS, usual)
    query.awaitTermination()
    return query


def put(rows: DataFrame, sink: str, run: str = "batch") -> None:
    """Append a table to the sink as one committed batch that no stream wrote."""
    number = committed(rows.sparkSession, sink).filter(F.col(RUN) == run).count()
    rows.write.mode("overwrite").parquet(f"{sink}/{RUN}={run}/{BATCH}={number}")
    rows.sparkSession.range(1).select(F.lit(rows.sparkSession.read.schema(rows.schema).parquet(f"{sink}/{RUN}={run}/{BATCH}={number}").count()).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{manifest(sink)}/{RUN}={run}/{BATCH}={number}")


def new_only(sink: str, key: str):
    """Leaves out rows whose key the sink has from other runs: the stream's own state knows the keys of its own run.

    The other runs' keys are read only if there are such runs, which is when a ledger was lost or rows were put by hand.
    """

    def left(batch: DataFrame, run: str) -> DataFrame:
        spark = batch.sparkSession
        if committed(spark, sink).filter(F.col(RUN) != run).isEmpty():
            return batch
        have = sink_rows(spark, sink, T.StructType([batch.schema[key]]).add(RUN, T.StringType())).filter(F.col(RUN) != run)
        return batch.join(have.select(key).distinct(), key, "left_anti").select(*batch.columns)

    return left


def ingest(source: DataFrame, sink: str, checkpoint: str, key: str = "id", partitions: int | None = None):
    """Drain a streaming source into the sink, one row a key; returns when all that is there has been written."""
    return drain(source.dropDuplicates([key]), sink, checkpoint, new_only(sink, key), partitions=partitions)


def todo(want: DataFrame, sink: DataFrame, key: str = "id") -> DataFrame:
    """What the sink still lacks, whatever a ledger says."""
    return want.join(sink.select(key), key, "left_anti")


def running(rounds: DataFrame) -> DataFrame:
    """Per id and round, the sums so far of logp and len (rounds extend a sample step by step)."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumns({"logp_sum": F.sum("logp").over(w), "len_sum": F.sum("len").over(w)})
