"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of ORDER words with Dirichlet smoothing: for a history h of k words,
  p(w | h) = (c(h w) + MU_k * p(w | h without its first word)) / (c(h) + MU_k),
over a unigram level p(w) = (1 - u) * c(w) / N with one class for unknown words, u = (n1 + 1) / (N + n1 + 1)
(n1: tokens seen once). Every history with a count is a state; a seen n-gram is an arc whose weight is
log10 p(w | h), to the state of the longest history that it ends with; a state's failure arc leads to the next shorter
history, of weight log10(MU_k / (c(h) + MU_k)). Since the numerator is interpolated, this automaton gives exactly
p(w | h). A document is read once from left to right; its state goes along and the log-probabilities add up.

Scale: the model grows with the corpus and is never held whole. Documents are dealt into groups of about
GROUP_BYTES by a hash of id and text; equal rows are one document with a number. Each group asks for the n-grams that
it holds, as sorted hashes cut into buckets; a bucket adds up the training counts of all groups and answers each with
counts in the order asked; each group then builds the part of the automaton that its own texts can reach. N-grams are
counted within a group before they move, so a frequent one is one entry a group, not a row an occurrence. Texts are
dealt once: asking and scoring read the same exchange. A group sends a row a bucket that it has n-grams in, so there are never more
rows than n-grams of groups; the totals N, V and n1 are one row, which the buckets of single words add up to and which is broadcast.

Edge cases: a null text is an empty one, whose only token is the end; a null id counts as training (its
remainder is none) and held_out is false; repeated rows count each and are returned each; without training tokens every token is
unknown; an empty table gives no row; extra columns are ignored. Words are told apart by 64-bit hashes, longer n-grams
by as many bits as leave odds of 2**-SPARE_BITS that one is taken for another of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votemill.llm.bpe import chunks
from votemill.llm.common import materialize, small
from votemill.llm.shingles import U, mix, ngrams, word_hashes

ORDER, MU = 3, (0.0, 60.0, 8.0)
GROUP_BYTES, BUCKET_ENTRIES = 8_000_000, 1_500_000
COPIES, SPARE_BITS = 4096, 22
#: Tokens of a text that one lane of the traversal scores.
LANE = 512
END = mix(np.array([1], U))[0]


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the offsets of the texts."""
    raw = [(t or "").encode() for t in texts]
    parts = [word_hashes(raw[a:b]) for a, b in chunks(raw)]
    h = np.concatenate([np.zeros(0, U), *(p[0] for p in parts)])
    off = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[1]) for p in parts)]))])
    n = len(off) - 1
    out = np.full(len(h) + n, END, U)
    own = np.ones(len(out), bool)
    own[off[1:] + np.arange(n)] = False
    out[own] = h
    return out, off + np.arange(n + 1)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def pack(x: np.ndarray) -> bytes:
    """Integers by byte planes; the two highest planes, whose values are uneven, are compressed."""
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = 8 - int(np.argmax(raw.any(0)[::-1])) if raw.any() else 1
    out = [len(x).to_bytes(8, "little"), bytes([used])]
    for k in range(used):
        plane = raw[:, k].tobytes()
        if k >= used - 2:
            plane = zlib.compress(plane, 1)
            out.append(len(plane).to_bytes(8, "little"))
        out.append(plane)
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    n, used, at = int.from_bytes(data[:8], "little"), data[8], 9
    out = np.zeros((n, 8), np.uint8)
    for k in range(used):
        if k >= used - 2:
            size = int.from_bytes(data[at : at + 8], "little")
            out[:, k] = np.frombuffer(zlib.decompress(data[at + 8 : at + 8 + size]), np.uint8)
            at += 8 + size
        else:
            out[:, k] = np.frombuffer(data, np.uint8, n, at)
            at += n
    return out.view("<u8").reshape(-1).astype(U)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as steps, whose leading bytes are zero; the first step is from zero."""
    return keys[:1].astype("<u8").tobytes() + pack(np.diff(keys))


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8").astype(U), unpack(data[8:])]), dtype=U)


class Group:
    """The n-grams of a group of documents: for each order k, their sorted distinct hashes (keys), how often they stand
    in training texts (counts), and for each token the place of the n-gram that starts there (-1 beyond its text)."""

    def __init__(self, tables, bits: int):
        ids, texts, copies = [], [], []
        for table in tables:
            ids += table.column("doc_id").to_pylist()
            texts += table.column("text").to_pylist()
            copies += table.column("copies").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids, self.copies = [ids[i] for i in order], [copies[i] for i in order]
        h, self.off = tokens_of([texts[i] for i in order])
        size = np.diff(self.off)
        self.left = np.repeat(self.off[1:], size) - np.arange(len(h))  # tokens of the text from here on
        train = np.repeat(np.array([0 if held_out(i) else n for i, n in zip(self.ids, self.copies)], np.int64), size)
        self.keys, self.counts, self.place = [], [], []
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(self.left >= k)
            g = (h if k == 1 else ngrams(h, k) >> U(64 - bits))[at]
            by = np.argsort(g)
            s = g[by]
            fresh = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
            first = np.flatnonzero(fresh)
            self.keys.append(s[first])
            self.counts.append(np.add.reduceat(train[at][by], first) if len(s) else np.zeros(0, np.int64))
            place = np.full(len(h), -1, np.int32)
            place[at[by]] = np.cumsum(fresh) - 1
            self.place.append(place)


class Buckets:
    """Ranges of hashes of each order; a bucket's number tells both."""

    def __init__(self, entries: int, bits: int):
        self.n, self.bits = max(1, -(-entries // BUCKET_ENTRIES)), bits

    def of(self, k: int, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(number, begin, end) of the buckets in which sorted keys of order k lie."""
        space = 64 if k == 1 else self.bits
        number = keys // U(-(-(1 << space) // self.n)) if self.n > 1 else np.zeros(len(keys), U)
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])[: len(number)])
        return list(zip(((k - 1) * self.n + number[first].astype(np.int64)).tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


ASKED = pa.schema([("bucket", pa.int64()), ("g", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("g", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary())])
TOTALS = pa.schema([("tokens", pa.int64()), ("types", pa.int64()), ("singles", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("copies", pa.int64())])
KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in schema)


def ask(buckets: Buckets):
    """From a group of documents: a row a bucket, with the n-grams asked for and the group's own counts."""

    def run(table: pa.Table) -> pa.Table:
        group, g = Group([table], buckets.bits), table.column("g")[0].as_py()
        rows = []
        for k, (keys, counts) in enumerate(zip(group.keys, group.counts), 1):
            for b, s, e in buckets.of(k, keys):
                rows.append((b, g, pack_keys(keys[s:e]), pack(counts[s:e])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ASKED)], schema=ASKED)

    return run


def added_up(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's requests: their sizes, the order that sorts their keys, the number of each sorted key, and each number's count."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    sizes = list(map(len, keys))
    every = np.concatenate(keys)
    where = np.argsort(every, kind="stable")
    s = every[where]
    del every, keys
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()])[where].astype(np.int64)
    return sizes, where, np.cumsum(new) - 1, np.add.reduceat(counts, np.flatnonzero(new))


def answer(buckets: Buckets):
    """Of a bucket: the counts that each group asked for."""

    def run(table: pa.Table) -> pa.Table:
        groups, number = table.column("g").to_pylist(), table.column("bucket")[0].as_py()
        sizes, where, key, total = added_up(table)
        of = np.empty(len(where), np.int64)
        of[where] = total[key]
        cut = np.cumsum([0, *sizes])
        rows = [(g, number, pack(of[a:b])) for g, a, b in zip(groups, cut[:-1], cut[1:])]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWERED)], schema=ANSWERED)

    return run


def totals(buckets: Buckets):
    """Of a bucket of single words: its training tokens, the words among them and those that stand once. Other buckets have none."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets.n:
            return TOTALS.empty_table()
        total = added_up(table)[3]
        return pa.table([[int(total.sum())], [int((total > 0).sum())], [int((total == 1).sum())]], schema=TOTALS)

    return run


class Automaton:
    """The part of the model that a group of texts can reach: states (0 is the empty history), arcs and failure arcs.

    arc_key holds state * words + word of every arc, sorted, arc_to the state it leads to and arc_weight its log10 p;
    fail_to and fail_weight belong to states. The empty history has an arc for every word of the group, so failing ends.
    """

    def __init__(self, group: Group, counts: list[np.ndarray], tokens: int, singles: int):
        self.off, self.word = group.off, group.place[0]
        self.words = max(len(counts[0]), 1)
        unknown = (singles + 1.0) / (tokens + singles + 1.0)
        keys, to, weights = [], [], []
        self.fail_to, self.fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        n_states, state, p = 1, [], None
        for k in range(1, ORDER + 1):
            place, c = group.place[k - 1], counts[k - 1].astype(np.float64)
            at = np.flatnonzero(place >= 0)
            start = np.empty(len(c), np.int64)
            start[place[at]] = at  # a token at which each n-gram starts
            seen = c > 0
            shorter = group.place[k - 2][start + 1] if k > 1 else None  # its last k - 1 words
            if k == 1:
                own, history, seen_arc = np.where(seen, (1 - unknown) * c / max(tokens, 1), unknown), np.zeros(len(c), np.int64), np.ones(len(c), bool)
            else:
                before = group.place[k - 2][start]  # its first k - 1 words
                own = (c + MU[k - 1] * p[shorter]) / (counts[k - 2][before] + MU[k - 1])
                history, seen_arc = state[-1][before], seen
            if k < ORDER:
                mine = np.zeros(len(c), np.int64)
                mine[seen] = n_states + np.arange(int(seen.sum()))
                n_states += int(seen.sum())
                self.fail_to.append(state[-1][shorter[seen]] if k > 1 else np.zeros(int(seen.sum()), np.int64))
                self.fail_weight.append(np.log10(MU[k] / (c[seen] + MU[k])))
                state.append(mine)
                target = mine
            else:
                target = state[-1][shorter] if k > 1 else np.zeros(len(c), np.int64)
            keys.append((history * self.words + self.word[start + k - 1])[seen_arc])
            to.append(target[seen_arc])
            weights.append(np.log10(own)[seen_arc])
            p = own
        self.fail_to, self.fail_weight = np.concatenate(self.fail_to), np.concatenate(self.fail_weight)
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.arc_key, self.arc_to, self.arc_weight = key[order], np.concatenate(to)[order], np.concatenate(weights)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes on its word, and the log10 weight: failure arcs until an arc is found."""
        state, gain = state.copy(), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[at] == key
            there, at = open_[hit], at[hit]
            gain[there] += self.arc_weight[at]
            state[there] = self.arc_to[at]
            open_ = open_[~hit]
            gain[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail_to[state[open_]]
        return state, gain

    def score(self) -> np.ndarray:
        """log10 probability of each text.

        Long texts are read in lanes of LANE tokens. A state holds the last ORDER - 1 words at most, so a lane that
        starts so many tokens early, from the empty history, has the text's own state where it begins to score.
        Lanes advance together, the longest first, so that those still open are a prefix.
        """
        size = np.diff(self.off)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = self.off[:-1][text] + part * LANE
        end = np.minimum(begin + LANE, self.off[1:][text])
        early = np.minimum(part * LANE, ORDER - 1)
        order = np.argsort(-(end - begin + early), kind="stable")
        text, begin, end, early = text[order], begin[order], end[order], early[order]
        length, total, state = end - begin + early, np.zeros(len(text)), np.zeros(len(text), np.int64)
        live = len(text)
        for t in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= t:
                live -= 1
            state[:live], gain = self.step(state[:live], self.word[begin[:live] - early[:live] + t])
            total[:live] += np.where(early[:live] <= t, gain, 0.0)
        return np.bincount(text, total, len(size))


def counts_of(buckets: Buckets, replies: pa.Table) -> list[np.ndarray]:
    """Of each order, the training counts of a group's n-grams."""
    rows = sorted(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()))
    return [np.concatenate([np.zeros(0, np.int64), *(unpack(c).astype(np.int64) for b, c in rows if b // buckets.n == k)]) for k in range(ORDER)]


def scorer(buckets: Buckets):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SCORED.empty_table()
        group = Group([docs], buckets.bits)
        group.keys = None
        counts = counts_of(buckets, replies)
        tokens, types, singles = (docs.column(c)[0].as_py() for c in TOTALS.names)
        score = Automaton(group, counts, tokens, singles).score()
        seen = counts[0][group.place[0]]
        base = np.log10((seen + 1.0) / (tokens + 1.0 * (types + 1.0)))
        base_score = np.add.reduceat(base, group.off[:-1])
        known = np.add.reduceat((seen > 0).astype(np.int64), group.off[:-1])
        held = pa.array([held_out(i) for i in group.ids])
        return pa.table([pa.array(group.ids, pa.int64()), held, np.diff(group.off), known, np.full(len(group.ids), tokens), base_score, score, pa.array(group.copies, pa.int64())], schema=SCORED)

    return run


def counted(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with equal rows as one and their number (copies), and whether there are equal rows."""
    key = F.xxhash64("doc_id", "text").alias("__key")
    twice = materialize(docs.groupBy(key).count().filter("count > 1").select("__key"), "twice")
    if twice.isEmpty():
        return docs.withColumn("copies", F.lit(1).cast("long")), False
    keyed, twice = docs.select("*", key), small(twice)
    once = keyed.join(twice, "__key", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    more = keyed.join(twice, "__key", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return once.unionByName(more), True


def lm_scores(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, repeated = counted(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    # About a word in six bytes; no order has more n-grams than there are words.
    words = size // 6 + 1
    buckets = Buckets(words, min(64, (ORDER * words).bit_length() + SPARE_BITS))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")
    dealt = docs.withColumn("g", key).repartition(groups, "g")
    request = dealt.groupBy("g").applyInArrow(ask(buckets), ddl(ASKED))
    request = request.repartition(-(-ORDER * buckets.n // 2), "bucket")  # about two buckets a task, however many there are
    reply = request.groupBy("bucket").applyInArrow(answer(buckets), ddl(ANSWERED))
    whole = request.groupBy("bucket").applyInArrow(totals(buckets), ddl(TOTALS)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS.names])
    out = dealt.join(F.broadcast(whole)).groupBy("g").cogroup(reply.groupBy("g")).applyInArrow(scorer(buckets), ddl(SCORED))
    if repeated:  # in two steps, so that no list is long
        out = out.withColumn("a", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
        out = out.withColumn("b", F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - a * {COPIES}))"))).drop("a", "b")
    return out.drop("copies")
