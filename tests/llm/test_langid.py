"""Language identification: forward-backward against all labellings, held-out accuracy, code-switched texts, edge cases."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from votemill.llm import langid

DOC = "doc_id long, text string, lang string, source string, score string, place long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def field(docs):
    return langid.fit(docs)


def random_chain(rng, n, words=30):
    return rng.random((words, n)) + 0.01, rng.random((n, n)) + 0.05, rng.random(n) + 0.05


def marginals(expo, word, off, move, start):
    out = np.zeros((len(word), len(start)))
    for _, at, p, _, _ in langid.posteriors(expo, word, off, move, start):
        out[at] = p
    return out


def test_posteriors_equal_all_labellings():
    rng = np.random.default_rng(5)
    expo, move, start = random_chain(rng, 3)
    off = np.array([0, 6, 6, 7, 12])
    word = rng.integers(0, 30, 12)
    got = marginals(expo, word, off, move, start)
    for a, b in zip(off[:-1], off[1:]):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.prod([expo[word[a + t], y] for t, y in enumerate(path)]) * np.prod([start[path[0]], *(move[x, y] for x, y in zip(path, path[1:]))]) if path else 0
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True), atol=1e-6)


@pytest.mark.parametrize("lane", [1, 3, 7])
def test_lanes_change_nothing(monkeypatch, lane):
    rng = np.random.default_rng(6)
    expo, move, start = random_chain(rng, 4)
    off = np.array([0, 50, 50, 57, 58, 200])
    word = rng.integers(0, 30, 200)
    whole = marginals(expo, word, off, move, start)
    monkeypatch.setattr(langid, "LANE", lane)
    assert np.allclose(marginals(expo, word, off, move, start), whole, atol=1e-6)


def test_held_out_texts_are_recognised(docs, field):
    rows = langid.languages(docs, field=field).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND length(text) > 100")
    n, good, score = rows.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg("score")).first()
    assert n > 100 and good >= 0.98 * n and score > 0.9


def test_code_switched_words(docs, field):
    """Texts made of held-out runs of different languages: most words get the language of their run."""
    rng = np.random.default_rng(8)
    pool = [(r["lang"], langid.WORD.findall(r["text"])) for r in docs.filter("crc32(CAST(doc_id AS string)) % 5 = 0 AND length(text) > 400").collect()]
    right = total = 0
    for _ in range(40):
        text, gold = "", []
        for k in rng.choice(len(pool), 4):
            lang, words = pool[k]
            at = rng.integers(0, len(words) - 10)
            for w in words[at : at + 10]:
                gold.append((len(text), lang))
                text += w + " "
        got = field.runs(text)
        right += sum(any(a <= at < b and lang == own for a, b, own in got) for at, lang in gold)
        total += len(gold)
    assert right >= 0.9 * total


def test_lexicon_and_transitions_are_learned(field):
    assert set(field.lexicon.values()) == set(range(len(field.langs)))
    assert all(field.move[k, k] > max(np.delete(field.move[k], k)) for k in range(len(field.langs)))


def test_spans_of_texts(spark, field):
    df = spark.createDataFrame([(1, "12 Und das ist der einheit, the of reand hation with anti!"), (2, None), (3, "123 -")], "doc_id long, text string")
    got = [tuple(r) for r in langid.language_runs(df, field).orderBy("doc_id", "start").collect()]
    assert [(i, lang) for i, _, _, lang in got] == [(1, "de"), (1, "en")]
    assert got[0][1] == 3 and got[1][2] == 57


def test_edges(spark, docs, field):
    odd = [
        (1, None, "en", "a", "x", 1), (2, "", "en", "a", "x", 1), (3, "12 .. ² ́ 5", "en", "a", "x", 1), (None, "the of and with", None, None, None, None), (4, "the of and with " * 60_000, "xx", "a", "x", 1),
        (5, "the of and with", "fr", "a", "x", 1), (5, "the of and with", "fr", "a", "x", 1), (6, "und" * 5000, "de", "a", "x", 1), (7, "İSTANBUL ǅ\x00 \U0001f389é", "de", "a", "x", 1),
    ]
    df = spark.createDataFrame(odd, DOC)
    got = langid.languages(df, field=field).collect()
    assert len(got) == len(odd)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[None]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == "en" and by[4]["score"] > 0.9
    assert all(0 <= r["score"] <= 1 and r["held_out"] == langid.held_out(r["doc_id"]) for r in got)
    empty = df.limit(0)
    assert langid.languages(empty).count() == 0
    assert {r["lang_pred"] for r in langid.languages(df.filter("lang IS NULL")).collect()} == {"und"}
    one = langid.languages(docs.filter("lang = 'de'").limit(30).unionByName(df.select("doc_id", "text", F.lit("de").alias("lang")))).collect()
    assert {r["lang_pred"] for r in one} == {"de", "und"} and all(r["score"] in (0.0, 1.0) or r["score"] > 0.999 for r in one)


def test_training_sample_is_bounded(spark, docs):
    copies = spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("ein text der oft da ist").alias("text"), F.lit("de").alias("lang"))
    runs = langid.training_runs(docs.unionByName(copies), 200).collect()
    assert max(sum(r["lang"] == k for r in runs) for k in {r["lang"] for r in runs}) <= 50
    assert all(sum(map(len, r["runs"])) <= langid.SPANS * langid.SPAN for r in runs)
    assert len({(r["lang"], r["place"]) for r in runs}) == len(runs)


def test_languages_and_ids_are_no_inputs(docs, field):
    some = docs.limit(60)
    other = some.select((F.col("doc_id") * 5 + 1).alias("doc_id"), "text", F.lit("de").alias("lang"))
    a = sorted((r["doc_id"] * 5 + 1, r["lang_pred"], r["score"]) for r in langid.languages(some, field=field).collect())
    assert a == sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.languages(other, field=field).collect())


def test_split_reads_whole_texts():
    word, off, words = langid.split(pa.array(["Ab, cd", None, "", "x" * 100_000, "ab"]))
    assert np.diff(off).tolist() == [2, 0, 0, 1, 1] and [words[i] for i in word] == ["ab", "cd", "x" * 100_000, "ab"]
