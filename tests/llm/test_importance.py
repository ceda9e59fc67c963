"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from votemill.llm import importance

SCHEMA = "doc_id long, text string, weight string, bucket int, row_ long, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, min_words=20, percent=5):
    coded = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in coded for b in f), Counter(b for x in target for b in buckets(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10000) / ((s[b] + 1.0) * (tt + 10000))))
    rows = []
    for i, n, f in coded:
        weight, score = sum(map(gain, f)), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, n >= min_words])
    fit = sorted((r for r in rows if r[4] and r[3] is not None), key=lambda r: (-r[3], r[0]))
    drawn = percent * len(fit) // 100
    places = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return sorted(((*r[:4], places.get(id(r))) for r in rows), key=str)


def found(spark, docs, target, **settings):
    df = spark.createDataFrame([(i, t, "x", 1, 2, "z") for i, t in docs], SCHEMA)
    return sorted(map(tuple, importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), **settings).collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return docs, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_against_plain_python(spark, texts):
    docs, target = texts
    odd = [(-1, None), (-2, ""), (-3, " .,-\n"), (-4, "one"), (-5, "ONE two É é"), (None, "a text without an id " * 9), (-6, "wort größe 東京 x1 " * 4000), (7, "the same id " * 9), (7, "another text " * 20)]
    got = found(spark, docs + odd + [(-8, "copies of a text " * 6)] * 40, target)
    assert got == plain(docs + odd + [(-8, "copies of a text " * 6)] * 40, target)


def test_ranks_over_several_ranges(spark, texts, monkeypatch):
    monkeypatch.setattr(importance, "ranked", lambda rows, order, f=importance.ranked: f(rows, order, 20))
    assert found(spark, *texts, percent=60) == plain(*texts, percent=60)


def test_ranks_split_one_hot_key(spark, texts):
    """Rows equal in score and id stand in a range each of their own row numbers: no range holds them all."""
    docs, target = texts
    df = spark.createDataFrame([(3, "one and the same text " * 8)] * 400 + docs[:100], "doc_id long, text string")
    rows = importance.weighed(df, spark.createDataFrame([(t,) for t in target], "text string"))
    got = importance.ranked(rows, [F.desc("score"), F.asc("doc_id"), F.asc("row_")], 50).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 501))
    assert [r["score"] for r in sorted(got, key=lambda r: r["place"])] == sorted((r["score"] for r in got), reverse=True)


def test_empty_tables(spark, texts):
    docs, target = texts
    assert found(spark, [], target) == []
    assert found(spark, docs[:50], []) == plain(docs[:50], [])
    assert found(spark, [(None, None), (None, None)], []) == [(None, 0, 0, None, None)] * 2
