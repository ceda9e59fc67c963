"""Language of texts and of the words in them, by a linear-chain conditional random field.

Words are runs of letters and marks, in lower case. A word's features are the runs of one to GRAMS characters of the word
between two border signs (those at a border are its affixes) and the whole word, hashed into one table of weights, and the
lexicon that knows it: a language's lexicon has the words that the training sample shows LEXICON times or more and mostly in that language. The
weights of a word's features add up to its scores; learned transitions join the words of a text. Forward-backward gives each word's
probability of each language, given the whole text: so a text may change its language within a line. A text's language
is that with the most probability over all words, and its score the share of it.

The field is fitted on the driver to a bounded sample: of each language the ROWS / languages rows (LEAST at least) with the smallest hashes
of their content, and of each row at most SPANS runs of SPAN words from hashed places (drawn in the tasks; texts do not reach the driver).
Runs of different languages are put one behind the other, so that switches are learned. These bounds are parameters; prediction reads every
word of every text. Languages are a small set: one row of weights a language.

Scale: prediction is one pass over the rows where they are read, without a shuffle. Texts of a slice go step by step side by
side, longest first, and long texts in lanes whose
border vectors come from the lanes' products, so exactly; of a text only its words' numbers and one probability vector a word are held.

Edge cases: null texts and texts without a letter are `und` with score 0; without training rows every text is; with one language
every text with a letter is of that language; a null lang teaches nothing, nor does a row with a null id, which is never
held out; repeated rows count once in the sample and are each returned; of languages with equal probability the first in
order wins; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.bpe import parts
from votemill.llm.common import in_batches, materialize
from votemill.llm.shingles import U

ROWS, LEAST, SPANS, SPAN, SEQUENCE = 2000, 50, 4, 16, 4
BITS, GRAMS, LEXICON, MOSTLY = 18, 4, 5, 0.8
EPOCHS, BATCH, RATE, DECAY, SEED = 4, 48, 0.3, 1e-6, 7
FLOOR = -60.0
#: Words of a text that are read in one lane.
LANE = 512
#: Rows and bytes of texts that go side by side.
SLICE_ROWS, SLICE_BYTES = 1024, 2_000_000
OTHER, WORD, LETTER = r"[^\p{L}\p{M}]+", regex.compile(r"[\p{L}\p{M}]+"), r"\p{L}"
UNKNOWN, FOLDS, HELD = "und", 5, 0


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of texts (null: none): the number of each in a list of distinct lower-case words, the texts' offsets, and that list."""
    found = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), OTHER)
    coded = found.flatten().dictionary_encode()
    number, off = coded.indices.to_numpy(zero_copy_only=False), found.offsets.to_numpy().astype(np.int64)
    real = pc.match_substring_regex(coded.dictionary, LETTER).to_numpy(zero_copy_only=False)
    keep = real[number] if len(number) else np.zeros(0, bool)
    place = np.cumsum(real) - 1
    return place[number[keep]], np.concatenate([[0], np.cumsum(keep)])[off - off[0]], coded.dictionary.filter(pa.array(real)).to_pylist()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of the features of each word, and the words' offsets."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.repeat(np.cumsum(size), size)
    owner, at = np.repeat(np.arange(len(words)), size), np.arange(len(flat))
    found, own, h = [], [], flat
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = h[:-1] * U(0x9E3779B97F4A7C15) + flat[n - 1 :]
        fits = at[: len(h)] + n <= end[: len(h)]
        found.append(h[fits] + U(n << 56))
        own.append(owner[: len(h)][fits])
    powers = np.cumprod(np.concatenate([[1], np.full(max(size.max(initial=1) - 1, 0), 0xD6E8FEB86659FD93, U)]), dtype=U)
    start = np.cumsum(size) - size
    found.append((np.add.reduceat(flat * powers[at - start[owner]], start) if len(words) else flat[:0]) + U(63 << 56))
    own.append(np.arange(len(words)))
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    x = np.concatenate(found)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return (x >> U(64 - BITS)).astype(np.int64)[order], np.searchsorted(own[order], np.arange(len(words) + 1))


def lanes(expo: np.ndarray, word: np.ndarray, off: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into lanes of at most LANE words: the lanes' texts and offsets, the vector that meets each lane's first word from before, and
    the one that meets its last word from behind. Long texts' lanes are summed up as matrices, side by side, which are then put together in turn."""
    size = np.diff(off)
    count = np.maximum(-(-size // LANE), 1)
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    cut = np.append(off[:-1][text] + number * LANE, off[-1])
    before, behind = np.tile(start, (len(text), 1)), np.ones((len(text), len(start)))
    long = np.flatnonzero(count[text] > 1)
    if len(long):
        left = np.diff(cut)[long]
        whole = expo[word[cut[:-1][long]]][:, :, None] * np.eye(len(start))
        for t in range(1, int(left.max())):
            on = np.flatnonzero(left > t)
            m = (whole[on] @ move) * expo[word[cut[:-1][long[on]] + t]][:, None, :]
            whole[on] = m / m.max((1, 2), keepdims=True)
        for k, lane in enumerate(long):
            if number[lane]:
                v = before[lane - 1] @ whole[k - 1] @ move
                before[lane] = v / v.sum()
        for k in range(len(long) - 1, -1, -1):
            if number[long[k]]:
                v = move @ (whole[k] @ behind[long[k]])
                behind[long[k] - 1] = v / v.sum()
    return text, cut, before, behind


def posteriors(expo: np.ndarray, word: np.ndarray, off: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Forward-backward over texts side by side. expo: exponentiated scores of the distinct words; move, start: the same of transitions.

    Yields for one word of each text (or lane of a long one) at a time: the texts' numbers, the places of the words and their
    probabilities; and for words with a next one in the lane, the forward vectors and the next words' scores and backward vectors.
    """
    text, cut, before, end = lanes(expo, word, off, move, start)
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    text, first, size, before, beta = text[order], cut[:-1][order], size[order], before[order], end[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps + 1), "left")
    alpha = np.empty((int(off[-1]), len(start)), np.float32)
    a = before
    for t in range(steps):
        m = active[t]
        at = first[:m] + t
        a = expo[word[at]] * (a[:m] @ move if t else before[:m])
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    back = move.T.copy()
    for t in range(steps - 1, -1, -1):
        m, more = active[t], active[t + 1]
        at = first[:m] + t
        behind = expo[word[first[:more] + t + 1]] * beta[:more]
        if more:
            b = behind @ back
            beta[:more] = b / b.sum(1, keepdims=True)
        forward = alpha[at].astype(float)
        p = forward * beta[:m]
        p /= p.sum(1, keepdims=True)
        yield text[:m], at, p, forward[:more], behind


class Field:
    """Languages, weights of features, lexicons, transitions and start scores."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.weights = langs, np.zeros(((1 << BITS) + n, n), np.float32)
        self.move, self.start, self.lexicon = np.zeros((n, n)), np.zeros(n), {}

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of words, those of the lexicons among them."""
        at, off = features(words)
        own = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        hit = np.flatnonzero(own >= 0)
        return np.insert(at, off[1:][hit], own[hit] + (1 << BITS)), off + np.concatenate([[0], np.cumsum(own >= 0)])

    def scores(self, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[at], off[:-1], axis=0) if len(at) else np.zeros((0, len(self.langs)), np.float32)

    def expo(self, words: list[str]) -> np.ndarray:
        out = [np.zeros((0, len(self.langs)))]
        for a in range(0, len(words), 20_000):
            s = self.scores(*self.known(words[a : a + 20_000])).astype(float)
            out.append(np.exp(np.maximum(s - s.max(1, keepdims=True), FLOOR)))
        return np.concatenate(out)

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(self.move - self.move.max()), np.exp(self.start - self.start.max())

    def fit(self, spans: list[tuple[int, list[str]]]) -> Field:
        """spans: language and words of each run."""
        rng = np.random.default_rng(SEED)
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for _, words in spans]
        lang = np.array([k for k, _ in spans])
        seen = np.zeros((len(vocabulary), len(self.langs)))
        for k, c in zip(lang, coded):
            np.add.at(seen, (c, k), 1)
        words = list(vocabulary)
        for i in np.flatnonzero((seen.sum(1) >= LEXICON) & (seen.max(1) >= MOSTLY * seen.sum(1))):
            self.lexicon[words[i]] = int(seen[i].argmax())
        at, off = self.known(words)
        g_w, g_m, g_s = np.full(self.weights.shape, 1e-3, np.float32), np.full(self.move.shape, 1e-3), np.full(self.start.shape, 1e-3)
        for _ in range(EPOCHS):
            order = rng.permutation(len(spans))
            sequences = [order[a : a + SEQUENCE] for a in range(0, len(order), SEQUENCE)]
            for a in range(0, len(sequences), BATCH):
                batch = sequences[a : a + BATCH]
                token = np.concatenate([coded[i] for s in batch for i in s])
                gold = np.concatenate([np.full(len(coded[i]), lang[i]) for s in batch for i in s])
                upto = np.concatenate([[0], np.cumsum([sum(len(coded[i]) for i in s) for s in batch])])
                used, word = np.unique(token, return_inverse=True)
                size = off[used + 1] - off[used]
                mine = np.repeat(off[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                s = self.scores(at[mine], np.concatenate([[0], np.cumsum(size)])).astype(float)
                move, start = self.chain()
                error, d_move, d_start = np.zeros((len(token), len(self.langs))), np.zeros(self.move.shape), np.zeros(len(self.langs))
                for _, place, p, forward, behind in posteriors(np.exp(np.maximum(s - s.max(1, keepdims=True), FLOOR)), word, upto, move, start):
                    error[place] = p
                    both = forward[:, :, None] * move * behind[:, None, :]
                    d_move += (both / both.sum((1, 2), keepdims=True)).sum(0)
                first = np.zeros(len(token), bool)
                first[upto[:-1][np.diff(upto) > 0]] = True
                d_start += error[first].sum(0) - np.bincount(gold[first], minlength=len(d_start))
                error[np.arange(len(token)), gold] -= 1
                np.subtract.at(d_move, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
                by_word = np.column_stack([np.bincount(word, error[:, k], len(used)) for k in range(len(self.langs))])
                feature, place = np.unique(at[mine], return_inverse=True)
                owner = np.repeat(np.arange(len(used)), size)
                d = np.column_stack([np.bincount(place, by_word[owner, k], len(feature)) for k in range(len(self.langs))]) / len(batch) + DECAY * self.weights[feature]
                g_w[feature] += d * d
                self.weights[feature] -= RATE * d / np.sqrt(g_w[feature])
                for x, g, dx in ((self.move, g_m, d_move / len(batch)), (self.start, g_s, d_start / len(batch))):
                    g += dx * dx
                    x -= RATE * dx / np.sqrt(g)
        return self

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's probability mass by language, and its number of words."""
        word, off, words = split(texts)
        mass = np.zeros((len(texts), len(self.langs)))
        if self.langs:
            for text, _, p, _, _ in posteriors(self.expo(words), word, off, *self.chain()):
                np.add.at(mass, text, p)
        return mass, np.diff(off)

    def runs(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and language of each run of words that most probably are of one language."""
        words = [w for w in WORD.finditer(text or "") if regex.search(LETTER, w.group())]
        if not words or not self.langs:
            return []
        best = np.zeros(len(words), np.int64)
        for _, at, p, _, _ in posteriors(self.expo([w.group().lower() for w in words]), np.arange(len(words)), np.array([0, len(words)]), *self.chain()):
            best[at] = p.argmax(1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(words)]])
        return [(words[a].start(), words[b - 1].end(), self.langs[best[a]]) for a, b in zip(cut[:-1], cut[1:])]


def training_runs(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """lang and runs of words of the sample. docs: doc_id, text, lang."""
    usable = docs.filter((F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spread = 1 << 40
    usable = usable.select("lang", "text", F.pmod(F.xxhash64("lang", "text"), F.lit(spread)).alias("place"))
    sizes = usable.groupBy("lang").count()  # a row a language
    each = F.greatest(F.lit(LEAST), F.floor(F.lit(rows) / F.greatest(F.count("*").over(Window.partitionBy()), F.lit(1))))
    sizes = materialize(sizes.select("lang", each.alias("each"), (2 * each + 100) / F.col("count") * spread), "languages").toDF("lang", "each", "below")

    def draw(batches):
        for batch in batches:
            lang, place, runs = [], [], []
            for a, piece in parts(batch.column("text"), SLICE_ROWS, SLICE_BYTES):
                word, off, words = split(piece)
                for i in range(len(piece)):
                    own = word[off[i] : off[i + 1]]
                    key = batch.column("place")[a + i].as_py()
                    at = range(0, len(own), SPAN) if len(own) <= SPANS * SPAN else np.sort(np.random.default_rng(key).choice(len(own) - SPAN + 1, SPANS))
                    lang.append(batch.column("lang")[a + i].as_py())
                    place.append(key)
                    runs.append([[words[w] for w in own[s : s + SPAN]] for s in at])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(place, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.string())))], names=["lang", "place", "runs"])

    near = usable.join(F.broadcast(sizes.select("lang", "below")), "lang").filter("place < below").select("lang", "text", "place")
    drawn = in_batches(near, draw, "lang string, place long, runs array<array<string>>")
    once = materialize(drawn.dropDuplicates(["lang", "place"]).join(F.broadcast(sizes.select("lang", "each")), "lang"), "runs")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place"))  # some 2 * each rows a language
    return once.withColumn("turn", turn).filter("turn <= each").select("lang", "place", "runs")


def fit(docs: DataFrame, rows: int = ROWS) -> Field:
    """docs: doc_id, text, lang."""
    found = training_runs(docs, rows).orderBy("lang", "place").collect()  # rows * SPANS * SPAN words at most
    langs = sorted({r["lang"] for r in found})
    spans = [(langs.index(r["lang"]), list(words)) for r in found for words in r["runs"] if words]
    return Field(langs).fit(spans) if spans else Field(langs)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", field: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a given field or one fitted to docs."""
    docs = prepared(docs, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def run(batches):
        field = model.value
        names = np.array([*field.langs, UNKNOWN], object)
        for batch in batches:
            for a, texts in parts(batch.column("text"), SLICE_ROWS, SLICE_BYTES):
                ids = batch.column("doc_id").slice(a, len(texts)).to_pylist()
                mass, n = field.shares(texts)
                none = (n == 0) | (not field.langs)
                best = np.where(none, len(field.langs), mass.argmax(1) if field.langs else 0)
                score = np.where(none, 0.0, np.minimum(mass.max(1, initial=0.0) / np.maximum(n, 1), 1.0))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_runs(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop and lang of the runs of words of one language in every text: code-switched texts have several."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                rows = model.value.runs(text.as_py())
                start, stop, lang = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(lang, pa.string())], names=["doc_id", "start", "stop", "lang"])

    return in_batches(docs, run, "doc_id long, start long, stop long, lang string")
