"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are the 64-bit hashes of its words (bytes between white space, A-Z in lower case) and of their
first 4 to 7 bytes, so that inflected forms share a term. A term that speaks for a label alone gets a linear
weight; pairs of terms interact through the inner product of their factors, so two terms that mean little
apart, such as an insult and the mention of a group, can mean much together. A text's score is
  sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct known terms that it has.

The machine is fitted to at most TRAIN_ROWS labelled rows, those with the smallest hash of their id; where ids have
several rows and these are more, equal rows count once and the ids give a text each in turn. Of their
terms, all that speak for or against toxicity by chi-square (above STRENGTH, in MIN_DOCS texts or more) are kept, so that the
model is as large as the sample makes it. The bounds are parameters; scoring covers every text whole. Ids, languages and sources are never inputs of a score.

Edge cases: null and empty texts have no term and score sigmoid(b), the machine's prior; without any usable label,
or with one label only, every score is that label's smoothed share; a null label is no label; an id with several labels is toxic
if one of them says so; a null id is never held out; repeated rows score alike; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.bpe import slices
from votemill.llm.common import first_by_hash, in_batches, materialize
from votemill.llm.shingles import U, Words, _BYTES, _INV, _P, _power, mix

TRAIN_ROWS, MIN_DOCS, STRENGTH, FACTORS = 20_000, 3, 10.8, 6
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.1, 2e-4, 11
THRESHOLD, PREFIXES, MASK = 0.3, (4, 5, 6, 7), (1 << 64) - 1


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the text of each."""
    words = Words(texts)
    total = np.concatenate([[U(0)], np.cumsum(_BYTES[words.raw] * _power(_P, len(words.raw)), dtype=U)])
    inverse = _power(_INV, len(words.raw))
    text = np.repeat(np.arange(len(texts)), np.diff(words.off))
    size = words.end - words.start
    hashes, owner = [words.h], [text]
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        start = words.start[at]
        hashes.append(mix((total[start + k] - total[start]) * inverse[start] + U(k * 0xD6E8FEB86659FD93 & MASK)))
        owner.append(text[at])
    return np.concatenate(hashes), np.concatenate(owner)


def known(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct known terms (by their place in the sorted vocabulary) of each text: place and text, ordered by text."""
    h, owner = terms([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    key = np.unique(owner[hit] * len(vocabulary) + at[hit])
    return key % len(vocabulary), key // len(vocabulary)


class Machine:
    """A factorization machine for 0/1 features, fitted with AdaGrad."""

    def __init__(self, size: int, prior: float):
        rng = np.random.default_rng(SEED)
        prior = min(max(prior, 1e-4), 1 - 1e-4)
        self.b = np.log(prior / (1 - prior))
        self.w = np.zeros(size)
        self.v = rng.normal(0, 0.01, (size, FACTORS))

    def margins(self, term: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[term]
        sums = np.column_stack([np.bincount(text, v[:, f], n) for f in range(FACTORS)])
        squares = np.bincount(text, (v * v).sum(1), n)
        return self.b + np.bincount(text, self.w[term], n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, term: np.ndarray, text: np.ndarray, labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        first = np.searchsorted(text, np.arange(len(labels) + 1))
        g_w, g_v, g_b = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                size = first[rows + 1] - first[rows]
                own = np.repeat(np.arange(len(rows)), size)
                t = term[np.arange(size.sum()) + np.repeat(first[rows] - (np.cumsum(size) - size), size)]
                margin, sums = self.margins(t, own, len(rows))
                error = (sigmoid(margin) - labels[rows]) / len(rows)
                used, place = np.unique(t, return_inverse=True)
                e = error[own]
                d_w = np.bincount(place, e, len(used)) + DECAY * self.w[used]
                pull = e[:, None] * (sums[own] - self.v[t])
                d_v = np.column_stack([np.bincount(place, pull[:, f], len(used)) for f in range(FACTORS)]) + DECAY * self.v[used]
                d_b = error.sum()
                g_w[used] += d_w**2
                g_v[used] += d_v**2
                g_b += d_b**2
                self.w[used] -= RATE * d_w / np.sqrt(g_w[used])
                self.v[used] -= 0.3 * RATE * d_v / np.sqrt(g_v[used])
                self.b -= RATE * d_b / np.sqrt(g_b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y of at most TRAIN_ROWS labelled rows that are not held out."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = first_by_hash(y.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "doc_id", TRAIN_ROWS)
    y = materialize(y, "labels")
    docs = docs.select("doc_id", "text")
    if docs.select("doc_id").join(F.broadcast(y), "doc_id").count() <= TRAIN_ROWS:
        return docs.join(F.broadcast(y), "doc_id")
    docs = docs.withColumn("place", F.xxhash64("text", "doc_id"))
    keys = docs.select("doc_id", "place").join(F.broadcast(y), "doc_id").distinct()
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    keys = keys.withColumn("turn", turn).filter(F.col("turn") <= TRAIN_ROWS).orderBy("turn", "place", "doc_id").limit(TRAIN_ROWS)
    return docs.join(F.broadcast(keys), ["doc_id", "place"]).select("doc_id", "text", "y").distinct().limit(TRAIN_ROWS)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Machine]:
    """The sorted vocabulary and the machine."""
    rows = materialize(training_rows(docs, labels), "training")

    def counts(batches):
        for batch in batches:
            y = np.array(batch.column("y").to_pylist(), np.int64)
            for a, b, texts in slices(batch.column("text")):
                h, owner = terms([t.encode("utf-8", "surrogatepass") for t in texts])
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
                term, place = np.unique(h[new], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(np.bincount(place, minlength=len(term))), pa.array(np.bincount(place, y[a:b][owner[new]], len(term)).astype(np.int64))], names=["term", "n", "p"]
                )

    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    positive = positive or 0
    if not n or positive in (0, n):
        return np.zeros(0, U), Machine(0, (positive + 1) / (n + 2))
    stats = in_batches(rows, counts, "term long, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    expected = F.col("n") * (positive / n)
    strength = (F.col("p") - expected) * (F.col("p") - expected) / (expected + 0.5)
    kept = stats.filter((F.col("n") >= MIN_DOCS) & (strength > STRENGTH)).select("term").toPandas()  # terms of TRAIN_ROWS rows
    vocabulary = np.sort(kept.term.to_numpy(np.int64).view(U))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def features(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column("text")):
                place, text = known(texts, shared.value)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(place, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("y").slice(a, b - a), lists], names=["doc_id", "y", "terms"])

    found = in_batches(rows, features, "doc_id long, y int, terms array<int>").orderBy("doc_id", "terms").toPandas()
    size = found.terms.map(len).to_numpy(np.int64)
    term = np.concatenate([*found.terms, np.zeros(0, np.int64)]).astype(np.int64)
    machine = Machine(len(vocabulary), positive / n)
    machine.fit(term, np.repeat(np.arange(len(found)), size), found.y.to_numpy(np.float64))
    return vocabulary, machine


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic")))

    def run(batches):
        vocabulary, machine = model.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1)):
                score = sigmoid(machine.margins(*known(texts, vocabulary), b - a)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([held_out(i) for i in ids[a:b]], pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return in_batches(docs, run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long"), "text"), labels.select("doc_id", "toxic")))

    def run(batches):
        vocabulary, machine = model.value
        for batch in batches:
            for a, b, texts in slices(batch.column("text")):
                score = sigmoid(machine.margins(*known(texts, vocabulary), b - a)[0])
                yield batch.slice(a, b - a).filter(pa.array(score < THRESHOLD))

    return in_batches(docs, run, docs.schema)
