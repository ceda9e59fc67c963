"""The pipeline's stages, one by one, against brute force on what each got."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from votemill.llm import ngram_join, substring_dedup


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "mixing", "bpe"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    sizes = [s.count() for s in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_decisions(spark, steps):
    _, clean, single, cut, mixed, _ = steps
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(clean).collect()}
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in found.items() if i == c}
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    seen = set()
    after = {r["doc_id"]: r for r in cut.collect()}
    assert set(after) == set(texts)
    for i in sorted(texts):
        kept, at = [], 0
        for _, s, e, hi, lo in zip(*(x.tolist() for x in substring_dedup.units([texts[i]]))):
            if (hi, lo) in seen:
                kept.append(texts[i][at:s])
                at = e
            seen.add((hi, lo))
        assert after[i]["text"] == "".join([*kept, texts[i][at:]]) and after[i]["n_chars"] == len(after[i]["text"])
    assert {r["doc_id"] for r in mixed.collect()} <= set(after)


def test_rows_without_or_with_one_id(spark, steps):
    schema = steps[0].schema
    text = "some words that make a text of more than five words"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text, "en", "a", 1), (3, None, "en", "a", 1), (4, "", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3, 4]
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() >= 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_extra_columns_pass(spark, steps):
    own = ["__n", "__spans", "__cut", "spans0", "weight", "p", "kept", "m_tokens", "row", "count", "component_id", "toxic", "score"]
    docs = steps[0].limit(60).select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own))
    docs = docs.unionByName(docs.limit(5))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF).cache()
        assert out.columns == docs.columns and out.count() > 0
    assert out.filter(" AND ".join(f"`{c}` = concat('{c}', doc_id)" for c in own)).count() == out.count()


def test_run(spark, steps):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in steps[-1].select("doc_id").collect()}
