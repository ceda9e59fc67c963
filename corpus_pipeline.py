"""A training corpus from `documents`: toxic documents go, one of each near-duplicate group stays, repeated passages
are cut, sources are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that it gets and returns a DataFrame; all but the last return
the columns of documents. A stage's result is written as Parquet and read again by the next one.

Edge cases: rows with a null doc_id never link, so they pass stage 2; of rows that share a doc_id one stays (that with
the smallest text); a text of which all was cut stays as an empty one; extra columns pass through all stages but the
last, whatever their names; the operators' own cases hold besides.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votemill.llm import mixing, ngram_join, substring_dedup, toxicity
from votemill.llm.bpe import encode_documents
from votemill.llm.common import materialize, read_table, small
from votemill.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(ngram_join.near_duplicates(docs).select("doc_id", "component_id"), "components")
    gone = materialize(found.filter("component_id != doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = materialize(twice, "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(small(twice), "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    one = F.min_by("row", F.struct(F.col("row.text"), F.xxhash64(F.to_json("row"))))  # partial: no task holds an id's rows
    once = again.groupBy("doc_id").agg(one.alias("row")).select("row.*")
    return kept.join(small(twice), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = next(name for i in count() if (name := f"spans{i}") not in docs.columns)
    out = substring_dedup.deduplicated(docs, spans).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: No SQL for the fitted classifier, links and merge rounds; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
