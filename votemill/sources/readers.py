"""Sources: JSON lines (strict, tolerant, last row of a key wins), CSV, globs of dumps, block files by records, JSON maps, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votemill.sources.schemas import SCHEMAS, normalize

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str | list[str], relation: str, tolerant: bool = False) -> DataFrame:
    """Rows of a relation. Malformed lines are an error, or are left out if tolerant."""
    schema = SCHEMAS.get(relation, relation)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def rejected_lines(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """The lines that do not parse, for counting what a tolerant scan leaves out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{SCHEMAS.get(relation, relation)}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    return parsed.filter(f"r.{CORRUPT} IS NOT NULL").select("value")


def last_wins(df: DataFrame, key: str = "id") -> DataFrame:
    """Of rows with the same key, the last one in file order (file name, then place in the file)."""
    place = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("place_")))
    return df.withColumn("place_", place).withColumn("r_", rank).filter("r_ = 1").drop("place_", "r_")


def problems(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of problems: quoted line breaks, a byte order mark and padded header names are understood."""
    return normalize(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path))


def submission(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows of a submission as texts, and its header as written."""
    df = spark.read.option("header", True).csv(path)
    header = [c.lstrip("﻿") for c in df.columns]
    return df.toDF(*(["id", "answer"] if len(header) == 2 else header)), header


def dumps(spark: SparkSession, glob: str, label: str = r"([^/]+)\.jsonl$", relation: str = "sample_dump") -> DataFrame:
    """All dumps of a glob, with `system` taken from each file's name."""
    rows = spark.read.schema(SCHEMAS[relation]).json(glob)
    return rows.withColumn("system", F.regexp_extract(F.input_file_name(), label, 1))


#: What parts a block file into records, and the first line of a record that begins a block.
RECORD, BLOCK_HEADER = "\n##", r"^#{2,4}\s*ID\s*[:：]\s*(\S+)[^\S\n]*(\n|$)"
#: Splits whose first numbers are broadcast at most.
SPLITS = 200_000


def records(spark: SparkSession, glob: str) -> DataFrame:
    """file, split (the byte at which the part of the file begins that a task reads), k (order within it) and text of the records of files.

    A file is parted at RECORD, so a large one is read by many tasks; k grows within a split, and splits follow each other by their bytes.
    """
    rows = spark.read.option("lineSep", RECORD).text(glob).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = rows.withColumn("k", F.monotonically_increasing_id())
    first = (F.col("split") == 0) & (F.row_number().over(Window.partitionBy("file", "split").orderBy("k")) == 1)
    return rows.select("file", "split", "k", F.when(first, F.col("value")).otherwise(F.concat(F.lit(RECORD[1:]), "value")).alias("text"))


def blocks(spark: SparkSession, glob: str) -> DataFrame:
    """file, place (from 1, within the file) and value of each block that begins with an id header.

    Records are numbered by the headers up to them: a split counts its own, and the counts of the file's splits before it are added, a row
    a split. Records without a header, such as other headings, belong to the block before.
    """
    rows = records(spark, glob).withColumn("head", F.col("text").rlike(BLOCK_HEADER).cast("long"))
    upto = F.sum("head").over(Window.partitionBy("file", "split").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.groupBy("file", "split").agg(F.sum("head").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # splits of a file
    counts = counts.select("file", "split", before.alias("before_"))
    counts = F.broadcast(counts) if counts.limit(SPLITS + 1).count() <= SPLITS else counts
    placed = rows.withColumn("own_", upto).join(counts, ["file", "split"]).withColumn("place", F.col("own_") + F.col("before_")).filter("place > 0")
    whole = placed.groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("split", "k", "text"))).alias("parts"))  # the records of one block
    return whole.select("file", "place", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("value"))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value of each entry of a file that is one JSON object; value: its type in DDL."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T._parse_datatype_string(f"map<string,{value}>"))))


def strata(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, "array<string>").select(F.col("key").alias("stratum"), F.explode("value").alias("id"))


def corrected_key(spark: SparkSession, path: str) -> DataFrame:
    entry = "struct<verdict:string,gold:string,ours:string,truth:string,note:string>"
    return json_map(spark, path, entry).select(F.col("key").alias("id"), "value.*")


def count_headers(spark: SparkSession, glob: str) -> DataFrame:
    """n: the number of distinct ids in the headers of block files."""
    ids = records(spark, glob).select(F.regexp_extract("text", BLOCK_HEADER, 1).alias("id")).filter("id != ''")
    return ids.agg(F.countDistinct("id").alias("n"))
