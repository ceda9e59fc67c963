"""Substring deduplication: units of a text are hashed, and of equal units only the first one stays.

Units are lines, and lines of more than WINDOW words are cut further at borders that the line's own words decide: a
border stands before a pair of words whose hash is the smallest of WINDOW neighbouring ones of the line. Equal lines of
CONTEXT words or more thus have equal units, whatever stands next to them. Plain lines would miss a passage
that was pasted into the middle of a line; with these borders both copies of a passage are cut alike, wherever
it stands, and the part between the first and the last border that its own words decide is removed (of any
passage of 50 words at least 50 - 2 * WINDOW). Units are compared in normal form (A-Z in lower case, white space
runs as one space). A unit of fewer than CONTEXT words says little on its own, so its digest also covers words
before it up to CONTEXT words, and it goes only where these repeat too: words of its line (for one that ends within
the line's first CONTEXT words, these words instead), or in a line of fewer words those of the lines before, back to the
text's start, which then belongs to the digest. So no unit is exempt for its size, and a clean text does not lose each
short line or word that some other text has as well. Digests are grouped over the whole corpus, the occurrence with the
smallest (doc_id, position) is kept and every other one is removed.

Results keep the original offsets: spans are [start, end) in code points of the original text, neighbours
merged, and cutting them out of it gives the kept text. White space after a unit belongs to it.

Edge cases: a null text stays null without spans; an empty text or one of white space only has no units; a
null doc_id ranks after all others, and its units are removed only where a document with an id has them (rows without
an id have no order); a document is a (doc_id, text digest), so rows that share a doc_id but not a text are cut each at
its own spans (the smaller digest first), while equal rows count as one and lose the same spans; an empty table gives
no row; extra columns stay whatever their names, but for one with the name of the spans column, which is replaced. Texts
are read whole. Digests have 128 bits.

Most units occur once. They are left out early: a first pass counts half of each digest alone, a filter of bits (a
few for each digest that repeats, BITS_MOST at most) tells the second pass which units may repeat, and only these are
stored with their places and compared by whole digests. The filter lets some others through, but none that repeats out. Units of a digest with
very many of them are spread over salts, and its first occurrence goes to each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votemill.llm.bpe import slices
from votemill.llm.common import in_batches, materialize
from votemill.llm.shingles import U, Words, mix, ngrams

WINDOW, CONTEXT = 12, 8
#: Bits of the filter: one for so many bytes of text, about 8 for each digest that repeats.
BYTES_A_BIT, BITS_LEAST, BITS_MOST = 64, 1 << 16, 1 << 28
#: Units of one digest that a task takes at most, in a corpus of up to HOT_MOST times as many; at most HOT_MOST digests are spread.
HOT, HOT_MOST = 10_000, 100_000
#: What tells documents apart.
DOCUMENT = ("doc_id", "text_id")


def spread(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of h times powers of base, and the inverse powers, for hashes of any range of words."""
    n = len(h)
    power = np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), base, U)])[:n], dtype=U)
    inverse = np.cumprod(np.concatenate([[U(1)], np.full(n, pow(base, -1, 1 << 64), U)]), dtype=U)
    return np.concatenate([[U(0)], np.cumsum(h * power, dtype=U)]), inverse


def line_starts(words: Words) -> np.ndarray:
    """The first word of every line that has words, and the number of words at the end."""
    line = np.cumsum(words.raw == 10)[words.start]  # texts are joined by line ends
    return np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(line)]])


def borders(words: Words, lines: np.ndarray) -> np.ndarray:
    """For each word, whether a unit starts there."""
    h = words.h
    n = len(h)
    out = np.zeros(n, bool)
    out[lines[:-1]] = True
    pair = ngrams(h, 2)
    if len(pair) >= WINDOW:
        view = np.lib.stride_tricks.sliding_window_view(pair, WINDOW)
        best = np.argmin(view, 1) + np.arange(len(view))
        line = np.repeat(np.arange(len(lines) - 1), np.diff(lines))
        out[best[line[: len(view)] == line[WINDOW : WINDOW + len(view)]]] = True  # windows within one line
    return out


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all units: the text, start and end in code points, and both halves of the digest."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = Words(raw)
    h, off = words.h, words.off
    n = len(h)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    lines = line_starts(words)
    first = np.flatnonzero(borders(words, lines))
    last = np.append(first[1:], n)
    text = np.searchsorted(off, first, "right") - 1
    line = np.searchsorted(lines, first, "right") - 1
    whole = lines[line + 1] - lines[line] >= CONTEXT
    begin = np.minimum(first, np.maximum(last - CONTEXT, np.where(whole, lines[line], off[text])))
    ahead = whole & (last - begin < CONTEXT)  # the line's first words
    stop = np.where(ahead, begin + CONTEXT, last)
    size = (last - first + (ahead * (first - begin + 1) << 40)).astype(U)  # and which of these words
    digest = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total, inverse = spread(mix(h ^ U(base)), base)
        digest.append(mix((total[stop] - total[begin]) * inverse[begin] + mix(size * U(base) + (stop - begin).astype(U))).view(np.int64))
    points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
    zero = points[words.first[text]]
    ends = points[words.first + np.array([len(r) for r in raw])][text]
    s = points[words.start[first]] - zero
    same = np.append(text[1:] == text[:-1], False)
    e = np.where(same, np.append(s[1:], 0), ends - zero)
    return text, s, e, digest[0], digest[1]


def text_id():
    return F.xxhash64(F.col("text")).alias("text_id")


def repeated_bits(docs: DataFrame) -> np.ndarray:
    """A filter of bits: that at lo modulo its size is set for every lo that occurs twice or more."""

    def run(batches):
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(units(texts)[4])], names=["lo"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(size // BYTES_A_BIT, BITS_LEAST), BITS_MOST) // 64 * 64
    at = in_batches(docs.select("text"), run, "lo long").groupBy("lo").count().filter("count > 1").select(F.pmod("lo", F.lit(n)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def has_bit(bits: np.ndarray, lo: np.ndarray) -> np.ndarray:
    at = lo % (len(bits) * 64)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def occurrences(docs: DataFrame) -> DataFrame:
    """hi, lo (the digest), doc_id, text_id, s, e of the units that may repeat, all that do among them."""
    bits = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs))

    def run(batches):
        for batch in batches:
            keys = batch.select([0, 1])
            for a, b, texts in slices(batch.column(2)):
                text, s, e, hi, lo = units(texts)
                may = has_bit(bits.value, lo)
                own = keys.slice(a, b - a).take(pa.array(text[may], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(hi[may]), pa.array(lo[may]), *own.columns, pa.array(s[may].astype(np.int32)), pa.array(e[may].astype(np.int32))], names=["hi", "lo", *DOCUMENT, "s", "e"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), text_id(), "text"), run, "hi long, lo long, doc_id long, text_id long, s int, e int")


def removed_units(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, s, e of the units that go. A digest that occurs once leaves with the first aggregate."""
    found = materialize(occurrences(docs), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *DOCUMENT, "s")
    first = found.groupBy("hi", "lo").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("hi", "lo", "n", F.col("keep.doc_id").alias("k_doc"), F.col("keep.text_id").alias("k_text"), F.col("keep.s").alias("k_s"))
    first = materialize(first, "first")
    same = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("text_id") == F.col("k_text"))
    gone = with_first(found, first).filter(~(same & (F.col("s") == F.col("k_s"))))
    return gone.filter("doc_id IS NOT NULL OR k_doc IS NOT NULL").select(*DOCUMENT, "s", "e")


def with_first(found: DataFrame, first: DataFrame) -> DataFrame:
    """found joined to first on the digest."""
    hot = max(HOT, (first.agg(F.sum("n")).first()[0] or 0) // HOT_MOST)  # so HOT_MOST digests at most have more
    salts = F.ceil(F.col("n") / F.lit(hot)).cast("int")
    many = F.broadcast(first.filter(F.col("n") > hot).select("hi", "lo", salts.alias("salts")))
    salt = F.pmod(F.xxhash64(*DOCUMENT, "s"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = found.join(many, ["hi", "lo"], "left").select(*found.columns, salt.alias("salt"))
    return dealt.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["hi", "lo", "salt"])


def deduplicated(docs: DataFrame, spans: str = "removed_spans") -> DataFrame:
    """docs with text replaced by what is kept, and the removed spans of the original text in a column of that name."""
    docs = docs.drop(spans)
    names = docs.columns
    gone = removed_units(docs.select("doc_id", "text")).groupBy(*DOCUMENT).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("cut"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), text_id().alias("own"))
    packed = packed.join(gone, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("text_id")), "left").select("row", "cut")

    def run(batches):
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
            columns = dict(zip(names, batch.column(0).flatten()))
            texts, cuts = columns["text"].to_pylist(), batch.column(1).to_pylist()
            cleaned, merged = [], []
            for t, cut in zip(texts, cuts):
                own: list[dict] = []
                for x in cut or []:
                    if own and own[-1]["e"] == x["s"]:
                        own[-1]["e"] = x["e"]
                    else:
                        own.append(dict(x))
                if t is not None and own:
                    parts, at = [], 0
                    for x in own:
                        parts.append(t[at : x["s"]])
                        at = x["e"]
                    t = "".join([*parts, t[at:]])
                cleaned.append(t)
                merged.append(own)
            columns["text"] = pa.array(cleaned, pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(merged, kind)], names=[*names, spans])

    span = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
    return in_batches(packed, run, T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(span))]))
