"""The queries of this package, with production parameters over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from votemill.llm.common import read_table

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), digests=True)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.token_store import token_store

    return token_store(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), END_ID)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.quality import quality

    return quality(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.mixing import mixing

    return mixing(read_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.lm import lm_scores

    return lm_scores(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.substring_dedup import deduplicated

    return deduplicated(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.ngram_join import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.nearest import nearest

    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.toxicity import scored

    return scored(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.html_text import main_text

    return main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.centroids import clustered

    return clustered(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.importance import resampled

    return resampled(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "text"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from votemill.llm.langid import languages

    return languages(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op5_token_store, op6_quality, op8_mixing, op10_lm, op3_substring_dedup, op2_ngram_join, op4_nearest, op7_toxicity, op9_html, op11_centroids, op12_importance, op13_langid)}


def oracle_sql() -> dict[str, str]:
    from votemill.llm import centroids, importance, mixing, quality

    return {"op6_quality": quality.SQL, "op8_mixing": mixing.sql(), "op11_centroids": centroids.sql(), "op12_importance": importance.sql()}
