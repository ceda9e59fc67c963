"""The training-data operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from oracle import rows
from pyspark.sql import functions as F

from votemill.llm import bpe, components, html_text, lm, mixing, nearest, ngram_join, quality, queries, shingles, substring_dedup, token_store, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string, hi long"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away. " * 3, "en", "a", 0, "x", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs far away. " * 3, "en", "a", 0, "x", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs far away. " * 3, "en", "a", 0, "x", 1),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "", 0),
    (5, " \n\t ", "de", "b", 3, "", 0),
    (None, "a text without an id, of some words at least, to see what becomes of it in the end", "en", "c", 0, "", 0),
    (7, "one two", "fr", "c", 7, "", 0),
    (8, "wörter über Straßen " * 3000, "de", "d", 0, "", 0),
    (9, "<|endoftext|> it's 12 o'clock\x1cnow ΣΑΣ", "en", "d", 0, "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).fetchdf())


def test_bpe_matches_library(spark, docs, odd, library):
    for frame in (docs, odd):
        got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(frame, queries.tokenizer_path(), digests=True).collect()}
        want = set()
        for i, text in pairs(frame):
            ids = library.encode(text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert got == want


def test_bpe_overlapping_pairs_and_characters(library):
    own, lib = bpe.WordBpe(queries.tokenizer_path()), token_store.LibraryBpe(queries.tokenizer_path())
    texts = ["a" * n for n in range(40)] + ["ha" * 30, "J̌ ǰ É.", "a b c", "..a.. 'S 're!!'s", "日本語 🎉🎉🎉", "<|endoftext", "<|startoftext|>x<|endoftext|>"]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}.'s" for c in range(0x250)]
    for coder in (own, lib):
        flat, off = coder.encode_batch(texts)
        assert [flat[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_bpe_matches_library_on_random_strings(library):
    own, lib = bpe.WordBpe(queries.tokenizer_path()), token_store.LibraryBpe(queries.tokenizer_path())
    rng = random.Random(3)
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    odd = ["a", "B", "é", "\u0301", "\u0327", " ", "\t", "\x1c", "\x85", "\xa0", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "ᄀ", "ᅡ", "ᆨ", "Σ", "İ", "ǅ", ".", "\u2003", "\x00", "\n"]
    texts = [f"a{chr(c)}B {chr(c)}'s{chr(c)}1" for c in points[::7]]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for base in (0x300, 0x590, 0xC00, 0x10D00, 0x16F00):
        texts += ["".join(chr(base + rng.randint(0, 255)) for _ in range(rng.randint(1, 6))) for _ in range(1000)]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for coder in (own, lib):
        for step in (len(texts), 700):
            got = []
            for a in range(0, len(texts), step):
                flat, off = coder.encode_batch(texts[a : a + step])
                got += [flat[s:e].tolist() for s, e in zip(off[:-1], off[1:])]
            assert got == want


def test_bpe_composes_before_lower_case(library):
    """Every capital with every combining mark, alone, inside a word and behind another mark."""
    marks = [chr(c) for c in itertools.chain(range(0x300, 0x370), range(0x1AB0, 0x1AFF), range(0x1DC0, 0x1E00), range(0x20D0, 0x20F1), range(0xFE20, 0xFE30))]
    texts = [t for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for t in (a + m, f"x{a}{m}y {a}{m}\u0301", f"{a}\u0323{m}b")]
    texts += ["H\u0331 T\u0308 W\u030a Y\u030a J\u030c", "aH\u0331b Tot\u0308T\u0308t", "Plain WORDS and H\u0331ere"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for coder in (bpe.WordBpe(queries.tokenizer_path()), token_store.LibraryBpe(queries.tokenizer_path())):
        flat, off = coder.encode_batch(texts)
        assert [flat[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == want


def test_bpe_full_memo(monkeypatch, library):
    monkeypatch.setattr(bpe.WordBpe, "memo_words", 50)
    monkeypatch.setattr(token_store.LibraryBpe, "memo_words", 50)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 300)}x" for _ in range(30)) for _ in range(40)]
    for coder in (bpe.WordBpe(queries.tokenizer_path()), token_store.LibraryBpe(queries.tokenizer_path())):
        for t in texts:
            assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(coder.known) <= 80


def test_bpe_empty(empty):
    assert bpe.encode_documents(empty, queries.tokenizer_path()).count() == 0


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(items):
    own = {i: sets(t) for i, t in items if i is not None}
    label = {i: i for i in own}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(own)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = own[a], own[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: find(i) for i in own}, own


def near_copies():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = [word() for _ in range(40)]
    out = []
    for base in range(6):
        words = [word() for _ in range(int(rng.integers(30, 120)))]
        for k in range(12):
            own = list(words)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = word()
            out.append((100 * base + k, " ".join(own)))
    out += [(1000 + k, " ".join(passage + [word() for _ in range(int(rng.integers(0, 16)))])) for k in range(40)]
    return out


def test_ngram_join_brute_force(spark, docs):
    for items in (near_copies(), pairs(docs)):
        frame = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
        got = ngram_join.near_duplicates(frame).collect()
        want, own = brute_components(items)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["n_shingles"] == len(own[r["doc_id"]]) for r in got)


def test_ngram_join_edges(odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    by = {i: (n, c) for i, n, c in got}
    assert by[1][1] == by[2][1] == 1 and by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[7] == (1, 7)
    assert by[None][1] is None
    assert ngram_join.near_duplicates(empty).count() == 0


def test_one_id_with_two_texts_is_one_node(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "eins zwei drei vier fünf sechs"
    frame = spark.createDataFrame([(5, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.near_duplicates(frame).collect()} == {5}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 90, 95: 90, 90: 90} or got == {**{i: 1 for i in range(2, 31)}, 100: 90, 95: 90}
    assert components.components(links.limit(0)).count() == 0


def plain_units(text):
    """(start, end, key) of each unit of a text, word by word; only the order of word pairs is taken from the hashes."""
    words = [(m.start(), re.sub("[A-Z]", lambda x: x[0].lower(), m[0]), text.count("\n", 0, m.start())) for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    names = [w for _, w, _ in words]
    pair = [shingles.ngrams(shingles.word_hashes([f"{x} {y}".encode()])[0], 2)[0] for x, y in zip(names, names[1:])]
    lines, found = [], []
    for _, group in itertools.groupby(range(len(words)), key=lambda k: words[k][2]):
        group = list(group)
        lines.append((group[0], group[-1] + 1))
    for begin, end in lines:
        cuts = {begin}
        for k in range(begin, end - substring_dedup.WINDOW):
            window = pair[k : k + substring_dedup.WINDOW]
            cuts.add(k + window.index(min(window)))
        cuts = sorted(cuts)
        for f, last in zip(cuts, [*cuts[1:], end]):
            if last - f >= 8:
                key = (names[f:last],)
            elif end - begin >= 8:  # words of its line
                key = (names[last - 8 : last], last - f) if last - 8 >= begin else (names[begin : begin + 8], last - f, f - begin)
            else:  # words before, or the start of the text
                key = (names[max(0, last - 8) : last], last - f, "start" if last < 8 else "")
            found.append((words[f][0], str(key)))
    ends = [s for s, _ in found[1:]] + [len(text)]
    return [(s, e, key) for (s, key), e in zip(found, ends)]


def plain_dedup(items):
    """What is left of each text, by position in items; ids differ and are not null."""
    seen, out = set(), {}
    for i, text in sorted(items):
        kept, at = [], 0
        for s, e, key in plain_units(text or ""):
            if key in seen:
                kept.append(text[at:s])
                at = e
            seen.add(key)
        out[i] = "".join([*kept, text[at:]]) if text is not None else None
    return out


def test_substring_dedup_brute_force(spark, docs):
    items = [*pairs(docs), (10**7, "Short line\nand more of them\nto end"), (10**7 + 1, "short LINE\nand  more\nto end"), (10**7 + 2, "one"), (10**7 + 3, "One"), (10**7 + 4, None)]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    want = plain_dedup(items)
    assert {i: r["text"] for i, r in got.items()} == want and want[10**7 + 3] == "" and want[10**7 + 1] == "and  more\nto end"
    for i, text in items:
        cut, at = [], 0
        for x in got[i]["removed_spans"]:
            cut.append(text[at : x["s"]])
            at = x["e"]
        assert text is None or "".join([*cut, text[at:]]) == got[i]["text"]


def test_substring_dedup_spreads_hot_digests(spark, monkeypatch):
    items = [(i, f"the same line of more than eight words stands in each\nbut number {i} of these is a line with words of its own") for i in range(300)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    want = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(docs).collect()}
    monkeypatch.setattr(substring_dedup, "HOT", 7)
    seen = []
    plain = substring_dedup.with_first
    monkeypatch.setattr(substring_dedup, "with_first", lambda found, first: seen.append(plain(found, first)) or seen[0])
    assert {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(docs).collect()} == want == plain_dedup(items)
    assert seen[0].select("salt").distinct().count() > 20


def test_substring_dedup_keeps_clashing_columns(spark):
    own = ["__cut", "row", "cut", "key", "own", "text_id", "s", "e", "hi", "lo", "n"]
    docs = spark.createDataFrame([(i, "a line that stands in both of these two documents here") for i in range(2)], "doc_id long, text string")
    docs = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own))
    got = substring_dedup.deduplicated(docs)
    assert got.columns == [*docs.columns, "removed_spans"] and got.filter("text = ''").count() == 1
    assert got.filter(" AND ".join(f"`{c}` = concat('{c}', doc_id)" for c in own)).count() == 2


def test_substring_dedup_finds_pasted_passages(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    words = lambda n: " ".join(word() for _ in range(n))
    passage = words(55)
    items = [(i, f"{words(int(rng.integers(1, 40)))} {passage} {words(int(rng.integers(1, 40)))}") for i in range(30)] + [(i, words(80)) for i in range(50, 60)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    assert sum(passage in got[i] for i in range(30)) == 1 and passage in got[0]
    assert all(got[i] == t for i, t in items if i >= 50)
    left = [sum(w in set(passage.split()) for w in got[i].split()) for i in range(1, 30)]
    assert np.mean(left) < 25


def uncut_lines(items, got):
    """Of lines of CONTEXT words or more that equal an earlier one: how many, and how many keep a word (plain lines, no hashes)."""
    seen, repeated, left = set(), 0, 0
    for i, text in sorted(items):
        gone = np.zeros(len(text), bool)
        for x in got[i]["removed_spans"]:
            gone[x["s"] : x["e"]] = True
        at = 0
        for line in text.split("\n"):
            key = " ".join(line.lower().split())
            if len(key.split()) >= substring_dedup.CONTEXT:
                if key in seen:
                    repeated += 1
                    left += not all(gone[at + k] for k, c in enumerate(line) if not c.isspace())
                seen.add(key)
            at += len(line) + 1
    return repeated, left


def test_substring_dedup_cuts_equal_lines(spark):
    rng = np.random.default_rng(12)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    shared = [words(int(n)) for n in rng.integers(8, 13, 60)] + [words(30) for _ in range(20)]
    items = [(i, "\n".join([words(int(rng.integers(2, 40))), line, words(int(rng.integers(2, 40)))])) for i, line in enumerate(shared + shared)]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    assert uncut_lines(items, got) == (80, 0)
    assert all(got[i]["text"] == t for i, t in items[:80])
    for i, t in items[80:]:
        before, _, after = t.split("\n")
        assert got[i]["text"] == f"{before}\n{after}"


def test_substring_dedup_share_cut_of_a_passage():
    rng = np.random.default_rng(14)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    shares = []
    for _ in range(500):
        passage = words(52)
        texts = [f"{words(20)} {passage} {words(20)}" for _ in range(2)]
        text, s, e, hi, lo = (x.tolist() for x in substring_dedup.units(texts))
        first = {d for t, d in zip(text, zip(hi, lo)) if t == 0}
        cut = " ".join(texts[1][x:y] for t, x, y, d in zip(text, s, e, zip(hi, lo)) if t == 1 and d in first)
        shares.append(len(set(cut.split()) & set(passage.split())) / 52)
    assert min(shares) >= 28 / 52 and np.mean(shares) > 0.77


def test_substring_dedup_filter_leaves_no_repeat_out(spark, docs, monkeypatch):
    key = lambda f: {(r["doc_id"], *map(tuple, r["removed_spans"])) for r in f.collect()}
    some = key(substring_dedup.deduplicated(docs))
    monkeypatch.setattr(substring_dedup, "repeated_bits", lambda _: np.full(1, -1))
    assert key(substring_dedup.deduplicated(docs)) == some


def test_substring_dedup_tells_texts_apart(spark):
    rng = np.random.default_rng(13)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    line, other, last = words(10), words(10), words(9)
    items = [
        (1, f"{line}\n{words(20)}"),
        (None, f"{words(12)}\n{line}\n{last}"),
        (None, f"{words(60)}\n{last}"),
        (2, f"{words(9)}\n{line}\n{other}"),
        (2, f"{words(40)}\n{words(3)}"),
        (2, f"{words(11)}\n{words(20)}\n{other}"),
        (2, f"{words(11)}\n{words(9)}"),
    ]
    items.append(items[3])
    got = {r["before"]: r for r in substring_dedup.deduplicated(spark.createDataFrame([(*x, x[1]) for x in items], "doc_id long, text string, before string")).collect()}
    a, b, c = items[1][1], items[3][1], items[5][1]
    assert got[a]["text"] == a.replace(line + "\n", "")
    assert all(got[items[i][1]]["text"] == items[i][1] for i in (0, 2, 4, 6))
    cut = b.replace(line + "\n", "")
    assert {got[b]["text"], got[c]["text"]} in ({cut, c.replace(other, "")}, {cut.replace(other, ""), c})
    for i, t in items:
        parts, at = [], 0
        for x in got[t]["removed_spans"]:
            assert x["s"] >= at
            parts.append(t[at : x["s"]])
            at = x["e"]
        assert "".join([*parts, t[at:]]) == got[t]["text"]


def test_substring_dedup_edges(odd, empty):
    got = substring_dedup.deduplicated(odd, "spans").collect()
    assert len(got) == len(ODD) and got[0].__fields__[-1] == "spans"
    by = {(r["doc_id"], i): r["text"] for i, r in enumerate(got)}
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[3] is None and texts[4] == "" and texts[5] == " \n\t " and texts[7] == "one two" and texts[None] == ODD[6][1]
    assert len(texts[2]) < len(ODD[1][1]) and len({t for (i, _), t in by.items() if i == 2}) == 1
    assert substring_dedup.deduplicated(empty).count() == 0


@pytest.mark.parametrize("kind, most", [("embeddings", 0.85), ("concentrated", 0.95), ("clustered", 0.2)])
def test_nearest_verifies_a_part(spark, kind, most):
    """The test spares exact distances, the more the less distances concentrate, and nine of ten neighbours are found."""
    rng = np.random.default_rng(2)
    if kind == "embeddings":
        v = np.array([r[0] for r in spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet").select("embedding").collect() if r[0] is not None and len(r[0]) == 64], float)
    else:
        v = rng.normal(size=(3000, 64)) + (12 * rng.normal(size=(30, 64))[rng.integers(0, 30, 3000)] if kind == "clustered" else 0)
    block = nearest.Block([[i] for i in range(len(v))], v)
    bound, found, total = nearest.chi_square_bound(nearest.CONFIDENCE, nearest.PROJECTED), 0, 0
    asked = range(0, len(v), 50)
    for q in asked:
        exact = np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")
        exact = [i for i in exact if i != q][:10]
        found += len({j for _, j in block.search(q, v[q], 10, bound)} & set(exact))
        total += 10
    assert found >= 0.9 * total and block.verified <= most * len(asked) * len(v)


def test_nearest_recall_and_edges(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(4)
    hard = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    for frame, k in ((table, 10), (hard, 10)):
        items = [(r[0], np.array(r[1], float)) for r in frame.collect()]
        ids, v = np.array([i for i, _ in items]), np.stack([x for _, x in items])
        got = nearest.nearest(frame, frame.filter("vec_id % 100 = 0"), k).orderBy("query_id", "rank").toPandas()
        hits = total = 0
        for q, g in got.groupby("query_id"):
            d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
            exact = [ids[j] for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            hits += len(set(exact) & set(g.vec_id))
            total += len(exact)
            assert list(g["rank"]) == list(range(1, len(g) + 1)) and np.allclose(g.score, [d[ids == j][0] for j in g.vec_id])
        assert hits / total >= 0.9
    same = [(i, [1.0] * 64, "x") for i in range(40)] + [(41, None, "x"), (42, [0.0] * 64, "x"), (43, [float("nan")] + [1.0] * 63, "x"), (44, [None] + [1.0] * 63, "x"), (45, [1.0] * 3, "x"), (None, [1.0] * 64, "x")]
    frame = spark.createDataFrame(same, "vec_id long, embedding array<double>, score string")
    got = nearest.nearest(frame, frame, 10).toPandas()
    assert set(got.query_id) == set(range(40)) and sorted(got[got.query_id == 0].vec_id) == list(range(1, 11)) and sorted(got[got.query_id == 20].vec_id) == list(range(10))
    assert nearest.nearest(frame.limit(0), frame.limit(0)).count() == 0


def exact_nearest(items, queries, k):
    """query -> [(vec_id, score)] of rows (id, vector), ids once each with their smallest distance."""
    out = {}
    for q in {i for i, _ in queries}:
        best = {}
        for j, v in items:
            for x in (x for i, x in queries if i == q and len(x) == len(v) and j != q):
                best[j] = min(best.get(j, math.inf), math.dist(v, x))
        out[q] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("dim", [1, 2, 12, 64])
def test_nearest_in_cells(spark, monkeypatch, dim):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(30, dim)) * 5
    items = [(i, (centres[i % 30] + rng.normal(size=dim)).tolist()) for i in range(2000)]
    items += [(i, items[0][1]) for i in range(2000, 2300)]  # one vector of many rows
    items += [(5, items[7][1]), (5, items[7][1]), (100, items[9][1]), (7000, [1.0] * (dim + 1)), (7100, [2.0] * (dim + 1))]
    frame = spark.createDataFrame(items, "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, frame.filter("vec_id % 100 = 0"), 5).orderBy("query_id", "rank").toPandas()
    want = exact_nearest(items, [x for x in items if x[0] % 100 == 0], 5)
    hits = total = 0
    assert set(got.query_id) == set(want)
    for q, g in got.groupby("query_id"):
        best = dict(exact_nearest(items, [x for x in items if x[0] == q], len(items))[q])
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and len(g) == len(want[q]) and g.vec_id.is_unique
        assert np.allclose(g.score, [best[j] for j in g.vec_id])
        hits += len({j for j, _ in want[q]} & set(g.vec_id))
        total += len(want[q])
    assert hits / total >= 0.9


def test_nearest_deals_large_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest, "CELLS_MOST", 3)
    rng = np.random.default_rng(0)
    items = [(i, rng.normal(size=4).tolist()) for i in range(900)]
    frame = spark.createDataFrame(items, "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, frame.filter("vec_id % 100 = 0"), 5).toPandas()
    want = exact_nearest(items, [x for x in items if x[0] % 100 == 0], 5)
    assert np.mean([len({j for j, _ in want[q]} & set(g.vec_id)) / 5 for q, g in got.groupby("query_id")]) >= 0.9


def test_nearest_bound():
    assert abs(nearest.chi_square(np.array([nearest.chi_square_bound(0.95, 10)]), 10)[0] - 0.95) < 1e-6


def test_nearest_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest, "CONFIDENCE", 1 - 1e-9)
    rng = np.random.default_rng(15)
    same, center = rng.normal(size=64), rng.normal(size=64)
    items = [(100, same)] * 60 + [(200, center + 0.01 * rng.normal(size=64)) for _ in range(30)] + [(i, center + rng.normal(size=64)) for i in range(40)] + [(0, same)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in items], "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, frame.filter("vec_id % 100 = 0 OR vec_id = 7"), 5).toPandas()
    for q in (0, 7, 100, 200):
        best = {}
        for i, v in items:
            if i != q:
                best[i] = min(best.get(i, math.inf), *(float(np.sqrt(((v - w) ** 2).sum())) for j, w in items if j == q), math.inf)
        own = got[got.query_id == q].sort_values("rank")
        assert list(own.vec_id) == sorted(best, key=lambda i: (best[i], i))[:5] and np.allclose(own.score, [best[i] for i in own.vec_id])


def test_token_store_round_trip(spark, docs, odd, library, tmp_path):
    frame = docs.unionByName(odd.filter("doc_id IS NULL OR doc_id IN (3, 4, 8, 9)").select((F.col("doc_id") + 1000000).alias("doc_id"), "text"))
    folder = str(tmp_path / "shards")
    got = token_store.token_store(frame, queries.tokenizer_path(), 2, folder).collect()
    start = 0
    items = sorted(pairs(frame), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i for i, _ in items]
    for r, (i, text) in zip(sorted(got, key=lambda r: r["start"]), items):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import pyarrow.fs as fs
    import zstandard

    name = next(x.path for x in fs.LocalFileSystem().get_file_info(fs.FileSelector(folder)) if x.path.endswith(".tok"))
    with fs.LocalFileSystem().open_input_file(name) as source:
        reader = token_store.ShardReader(source)
        every = [ids.tolist() for k in range(len(reader.frames)) for _, ids in reader.frame(k)]
        assert reader.document(len(every) - 1).tolist() == every[-1] and len(every) == len(reader.ids)
    raw = open(name, "rb").read()
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) > 0
    damaged = bytearray(raw)
    damaged[20] ^= 255
    open(name, "wb").write(damaged)
    with fs.LocalFileSystem().open_input_file(name) as source, pytest.raises(Exception):
        list(token_store.ShardReader(source).frame(0))


def test_token_store_splits_equal_ids(spark, library, tmp_path):
    """A third of the rows without an id and a third of one id, half of them equal: shards hold like numbers of rows."""
    rows_ = [(None, f"a text {i}") for i in range(600)] + [(7, "one text" if i % 2 else f"text {i}") for i in range(600)] + [(100 + i, "some text") for i in range(600)]
    frame, folder = spark.createDataFrame(rows_, "doc_id long, text string").repartition(6), str(tmp_path / "shards")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, the table would be one shard
    shards = token_store.write_shards(frame, folder, queries.tokenizer_path(), 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_docs"] for r in shards.collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * np.median(sizes)
    got = sorted(token_store.read_shards(shards, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in sorted(rows_, key=lambda x: (x[0] is not None, x[0] or 0))]
    want = Counter((i, zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows_)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_token_store_empty(empty):
    assert token_store.token_store(empty, queries.tokenizer_path(), 2).count() == 0


def test_quality_edges(odd, empty):
    got = quality.quality(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[8]["n_repeat_words"] == by[8]["n_words"] == 9000 and by[1]["n_repeat_words"] == by[1]["n_words"] == 39
    assert quality.quality(empty).count() == 0


def host_table(spark):
    rows_ = [("bad", i, i < 90, False) for i in range(100)]  # most fails: blocked
    rows_ += [("tiny", 1000 + i, i < 2, False) for i in range(3)]  # two of three fail, but too few to tell
    rows_ += [("clean", 2000 + i, False, i < 2) for i in range(400)]  # hardly any fails: trusted
    rows_ += [(f"usual{h}", 3000 + 100 * h + i, i < 10, i == 99) for h in range(30) for i in range(100)]
    return spark.createDataFrame(rows_, "host string, doc_id long, base_failed boolean, soft_failed boolean")


def test_quality_host_verdicts(spark):
    got = quality.judged(host_table(spark)).toPandas()
    verdicts = got.groupby("host").host_verdict.first()
    assert verdicts["bad"] == "blocked" and verdicts["clean"] == "trusted" and verdicts["tiny"] == verdicts["usual0"] == "strict"
    bad, clean, usual, tiny = (got[got.host == h] for h in ("bad", "clean", "usual0", "tiny"))
    assert not bad.kept.any() and (~bad.base_failed).sum() == 10  # ten documents go for their host alone
    assert clean.kept.all() and clean.soft_failed.sum() == 2  # two stay for their host alone
    assert usual.kept.sum() == 89 and tiny.kept.sum() == 1


def test_quality_shrinkage_saves_a_small_host(spark):
    """Of two hosts with one rate the large one is blocked, and of two clean ones only the large one is trusted."""
    rows_ = [("large", i, i < 200, False) for i in range(300)] + [("small", 1000 + i, i < 2, False) for i in range(3)]
    rows_ += [("spotless", 2000 + i, False, i == 0) for i in range(300)] + [("new", 3000, False, False)]
    rows_ += [(f"usual{h}", 4000 + 100 * h + i, i < 10 + h % 3, i == 99) for h in range(30) for i in range(100)]
    got = quality.judged(spark.createDataFrame(rows_, "host string, doc_id long, base_failed boolean, soft_failed boolean")).toPandas().groupby("host")
    verdicts, kept = got.host_verdict.first(), got.kept.sum()
    assert (verdicts["large"], verdicts["small"], verdicts["spotless"], verdicts["new"]) == ("blocked", "strict", "trusted", "strict")
    assert (kept["large"], kept["small"], kept["spotless"], kept["new"]) == (0, 1, 300, 1)


def test_quality_verdict_changes_rows(spark):
    """On the documents some hosts are judged otherwise than their documents by themselves."""
    got = quality.judged(quality.features(spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.1/documents.parquet"))).toPandas()
    own = ~got.base_failed & ~got.soft_failed
    assert (got.kept & ~own).any() and not (own & ~got.kept).any() and got.host_verdict.nunique() > 1


def mixing_table(spark):
    words = F.repeat(F.lit("word "), F.col("id").cast("int") % 7 + 3)
    df = spark.range(60_000).select(
        F.col("id").alias("doc_id"), words.alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"),
        F.when(F.col("id") % 10 < 7, "en").otherwise("de").alias("lang"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("theme"),
    )
    return df


def test_mixing_meets_marginals(spark):
    docs = mixing_table(spark)
    sources = ["hot", *(f"s{i}" for i in range(11))]
    for targets in ({"source": 0.5, "lang": 0.7, "topic": 0.7}, {"source": {s: 1.0 for s in sources}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"a": 0.3, "b": 0.7}}):
        got = mixing.marginals(docs, targets, 0.4, F.col("theme")).toPandas()
        assert np.allclose(got.target, got.expected, atol=1e-6) and np.allclose(got.target, got["sample"], atol=0.01)
        if isinstance(targets["lang"], dict):
            lang = got[got.dim == "lang"].set_index("value").target
            assert abs(lang["en"] - 0.6) < 1e-9 and abs(lang["de"] - 0.4) < 1e-9
        kept = mixing.mixed(docs, targets, 0.4, F.col("theme"))
        share = kept.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] / docs.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
        assert abs(share - 0.4) < 0.01


def test_mixing_fills_scarce_values(spark):
    docs = mixing_table(spark)
    got = mixing.marginals(docs, {"source": 1.0, "lang": {"de": 1.0, "en": 1.0}, "topic": {"a": 9.0, "b": 1.0}}, 0.5, F.col("theme")).toPandas()
    topic = got[got.dim == "topic"].set_index("value")
    # a has a fifth of all tokens, which is two fifths of the sample: more than that it cannot be given
    assert abs(topic.target["a"] - topic.before["a"] / 0.5) < 1e-9 and np.allclose(got.target, got.expected, atol=2e-3)
    nothing = mixing.mixed(docs, {"source": 1.0, "lang": {"de": 1.0}, "topic": 1.0}, 0.2, F.col("theme"))
    assert {r.lang for r in nothing.select("lang").distinct().collect()} == {"de"}


def test_mixing_keeps_clashing_columns(spark):
    own = ["weight", "p", "kept", "m_tokens", "m_source", "row", "t_m_lang", "s", "x", "tokens", "m_draw"]
    docs = mixing_table(spark).filter("doc_id < 300").select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own))
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and kept.count() > 50
    assert kept.filter(" AND ".join(f"`{c}` = concat('{c}', doc_id)" for c in own)).count() == kept.count()


def test_mixing_edges(odd, empty):
    got = mixing.mixing(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["p"] <= 1 for r in got)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(empty).count() == 0


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    items = []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[int(rng.integers(40))] = "moron" if i % 12 else "vequ" + word()
        items.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(items, "doc_id long, text string, toxic int")
    got = toxicity.scored(frame, frame).toPandas().merge(frame.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 200 and (held.predicted == held.toxic).mean() > 0.97
    kept = toxicity.clean(frame, frame)
    assert kept.columns == frame.columns and kept.count() == (got.predicted == 0).sum()


def test_toxicity_interactions():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (600, 2))
    y = (x[:, 0] & x[:, 1]).astype(float) * 1.0
    text, term = np.nonzero(x)
    machine = toxicity.Machine(2, 0.25)
    machine.v += rng.normal(0, 0.3, machine.v.shape)
    machine.fit(term, text, y)
    score = toxicity.sigmoid(machine.margins(np.array([0, 1, 0, 1]), np.array([0, 1, 2, 2]), 4)[0])
    assert score[2] > 0.5 > max(score[0], score[1], score[3]) and machine.v[0] @ machine.v[1] > 0


def plain_terms(text):
    """Distinct terms of a text: words (A-Z in lower case) and their first 4 to 7 bytes, if they are longer."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return set(words) | {w[:k] for w in words for k in toxicity.PREFIXES if len(w) > k}


def test_toxicity_terms_and_pairs(spark):
    """Scores are those of a plain sum over the weights and over all pairs of factors of a text's known terms."""
    docs = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    vocabulary, machine = toxicity.fit(docs, labels)
    texts = ["", None, "One two ONE onerous", *(t for _, t in pairs(docs)[:150])]
    for text in texts:
        h, _ = toxicity.terms([(text or "").encode()])
        assert len(set(h.tolist())) == len(plain_terms(text))
    place, owner = toxicity.known(texts, vocabulary)
    got = toxicity.sigmoid(machine.margins(place, owner, len(texts))[0])
    for i in range(len(texts)):
        own = place[owner == i].tolist()
        margin = machine.b + sum(machine.w[a] for a in own) + sum(float(machine.v[a] @ machine.v[b]) for a, b in itertools.combinations(own, 2))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    assert len(vocabulary) and got[0] == got[1] == pytest.approx(1 / (1 + math.exp(-machine.b)))


def test_toxicity_on_held_out_labels(spark):
    """Nearly all toxic texts that were held out are found, and nearly no clean one is flagged."""
    home = f"{SF.rsplit('/', 1)[0]}/sf0.1"
    labels = spark.read.parquet(f"{home}/labels.parquet").filter("toxic IS NOT NULL")
    got = toxicity.scored(spark.read.parquet(f"{home}/documents.parquet"), labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 50)
    free = [i for i in range(100) if not toxicity.held_out(i)][:31]
    hot, ids = free[0], free[1:]
    items = [(hot, f"row {i} of a hot id") for i in range(300)] + [(hot, "a hot row")] * 300 + [(i, f"text {i}") for i in ids]
    frame = spark.createDataFrame(items, "doc_id long, text string")
    labels = spark.createDataFrame([(hot, 1), *((i, 0) for i in ids)], "doc_id long, toxic int")
    got = [tuple(r) for r in toxicity.training_rows(frame, labels).select("doc_id", "text", "y").collect()]
    assert len(got) == len(set(got)) == 50 and {i for i, *_ in got} == {hot, *ids} and {y for i, _, y in got if i == hot} == {1}
    assert toxicity.scored(frame, labels).count() == len(items)


def test_toxicity_edges(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(odd, labels.limit(0)).count() == len(ODD) and toxicity.scored(empty, labels).count() == 0


def brute_lm(items):
    """doc_id -> n_tokens, n_known, N, base score and score, from plain counters; items are (id, text)."""
    words = [(i, [*(t or "").encode().lower().split(), None]) for i, t in items]
    grams = [Counter() for _ in range(lm.ORDER)]
    for i, w in words:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for k in range(lm.ORDER):
                grams[k].update(zip(*(w[j:] for j in range(k + 1))))
    n, v, single = sum(grams[0].values()), len(grams[0]), sum(c == 1 for c in grams[0].values())
    u = (single + 1) / (n + single + 1)

    def p(h, w):
        if not h:
            return (1 - u) * grams[0][(w,)] / n if grams[0][(w,)] else u
        return (grams[len(h)][(*h, w)] + lm.MU[len(h)] * p(h[1:], w)) / (grams[len(h) - 1][h] + lm.MU[len(h)])

    out = {}
    for i, w in words:
        base = sum(math.log10((grams[0][(x,)] + 1) / (n + 1 * (v + 1))) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, k - lm.ORDER + 1) : k]), x)) for k, x in enumerate(w))
        out[i] = (len(w), sum(grams[0][(x,)] > 0 for x in w), n, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_brute_force(spark, docs, monkeypatch, order):
    monkeypatch.setattr(lm, "ORDER", order)
    monkeypatch.setattr(lm, "MU", (0.0, 60.0, 8.0, 3.0))
    monkeypatch.setattr(lm, "GROUP_BYTES", 50_000)
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 20_000)
    monkeypatch.setattr(lm, "LANE", 100)
    items = pairs(docs) + [(10**6, None), (10**6 + 1, "")]
    # what workers import anew has the module's own constants, so the steps run here
    tables = {g: pa.table([[x[0] for x in own], [x[1] for x in own], [1] * len(own), [g] * len(own)], names=["doc_id", "text", "copies", "g"]) for g in range(4) if (own := items[g::4])}
    buckets = lm.Buckets(sum(len(t or "") for _, t in items) // 6, 50)
    asked = pa.concat_tables([lm.ask(buckets)(t) for t in tables.values()])
    numbers = np.array(asked.column("bucket").to_pylist())
    replied = pa.concat_tables([lm.answer(buckets)(asked.filter(pa.array(numbers == b))) for b in np.unique(numbers)])
    whole = pa.concat_tables([lm.totals(buckets)(asked.filter(pa.array(numbers == b))) for b in np.unique(numbers)])
    got = {}
    for g, t in tables.items():
        for name in lm.TOTALS.names:
            t = t.append_column(name, pa.array([sum(whole.column(name).to_pylist())] * t.num_rows))
        own = replied.filter(pa.array(np.array(replied.column("g").to_pylist()) == g))
        got |= {r["doc_id"]: r for r in lm.scorer(buckets)(t, own).to_pylist()}
    check_lm(got, items)


def check_lm(got, items):
    want = brute_lm(items)
    assert got.keys() == want.keys()
    for i, (n_tokens, n_known, n, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_lm_query(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 50_000)
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 20_000)
    items = pairs(docs) + [(10**6, None), (10**6 + 1, "")]
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    check_lm(got, items)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_requests_grow_with_the_groups():
    """However many buckets there are, a group asks those only that it has n-grams in, so requests grow as the groups do."""
    rng = random.Random(4)
    group = lambda g: pa.table({"doc_id": [g], "text": [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200))], "copies": [1], "g": pa.array([g], pa.int32())})
    for entries in (1, 10**8, 10**12):
        buckets = lm.Buckets(entries, 60)
        rows = [lm.ask(buckets)(group(g)).num_rows for g in range(40)]
        assert all(lm.ORDER <= r <= min(lm.ORDER * buckets.n, 3 * 201) for r in rows)
        assert abs(sum(rows) - 2 * sum(rows[:20])) <= 0.05 * sum(rows)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5], [1, 2**40, 2**64 - 1], list(range(3000))])
def test_lm_packed_numbers(values):
    x = np.array(values, np.uint64)
    assert np.array_equal(lm.unpack(lm.pack(x)), x)
    assert np.array_equal(lm.unpack_keys(lm.pack_keys(np.sort(x)) if values else b""), np.sort(x))


def test_lm_groups_of_a_hot_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(lm, "COPIES", 7)
    texts = [f"some words of text number {i} for a row" for i in range(400)]
    items = [(None, t) for t in texts[:200]] + [(5, t) for t in texts[200:]] + [(5, "the same row again")] * 300 + [(6, None)] * 2 + [(7, "own text")]
    seen, plain = spark.sparkContext.accumulator(0), lm.ask

    def ask(buckets):
        run = plain(buckets)

        def spied(table):
            assert sum(len(t or "") for t in table.column("text").to_pylist()) < 4 * 2_000
            seen.add(1)
            return run(table)

        return spied

    monkeypatch.setattr(lm, "ask", ask)
    got = lm.lm_scores(spark.createDataFrame(items, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in items) and seen.value > 5
    one = Counter(w for i, t in items if not lm.held_out(i) for w in [*(t or "").split(), None])
    assert {r["train_tokens"] for r in got} == {sum(one.values())}
    base = sum(math.log10((one[w] + 1) / (sum(one.values()) + len(one) + 1)) for w in [*"the same row again".split(), None])
    assert sum(math.isclose(r["base_score"], base, rel_tol=1e-9) for r in got) == 300


def test_lm_edges(odd, empty):
    got = lm.lm_scores(odd).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["n_tokens"] for r in got}[3] == 1 and lm.lm_scores(empty).count() == 0


def test_html_blocks():
    page = "<html><head><title>t</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p><b>one<br>two</b>\n three<p>four <i>five</i><!-- no --><ul><li>six<li>seven</ul></article></body>"
    got = [(b.text, "article" in b.path) for b in html_text.blocks(page)]
    assert got == [("Home", False), ("A & B", True), ("one two three", True), ("four five", True), ("six", True), ("seven", True)]


@pytest.mark.parametrize(
    "head",
    ["<head><meta charset=x><title>t</title><body>", "<head><title>t</title><link href=x>", "<head><title>t<body>", "<HEAD><title>t", "<head><title>a <b>t</b></title>", "<head><title>a <p> t</title><noscript><img src=x>n</noscript></head><body>"],
)
def test_html_open_head_ends(head):
    assert [b.text for b in html_text.blocks(f"<html>{head}<p>one</p><p>two <select><option>no</select>three</p>")] == ["one", "two", "three"]


def test_html_text_in_an_open_head():
    assert [b.text for b in html_text.blocks("<head><title>t</title> plain words<p>more")] == ["plain words", "more"]


def test_html_keeps_formulas_and_fallback_text():
    page = "<article><p>so <math><mi>E</mi><mo>=</mo><mrow><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math> holds</p><object data=x><p>a fallback</p></object><p>end</article>"
    assert [b.text for b in html_text.blocks(page)] == ["so E=mc2 holds", "a fallback", "end"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p class=it's>Hello world isn't here</p><p>next</p>", ["Hello world isn't here", "next"]),
        ("<p title=it's>Alpha beta</p>", ["Alpha beta"]),
        ("<p title='a > b' data-x = \"c>d\" checked>Alpha</p><p a=\"open>beta</p>", ["Alpha", "beta"]),
        ("<article><p>one</p><noscript><p>two</p></noscript></article>", ["one", "two"]),
    ],
)
def test_html_attributes_and_fallbacks(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


#: Pages written by hand, and their articles.
HAND = [
    (
        """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Bread at home | Kitchen Notes</title><style>p{color:red}</style></head><body>
<header><a href="/">Kitchen Notes</a><nav><ul><li><a href="/recipes">Recipes</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies to improve your visit. <button>Accept</button></div>
<main><article><h1>Bread at home</h1><p class=it's>Good bread doesn't need a machine. It takes flour, water, salt &amp; time, and an oven that gets hot.</p>
<p>Mix the flour and the water in the evening. Leave the dough in a cool place until the morning, then fold it <em>three</em> times.</p>
<ul><li>500 g of flour</li><li>350 g of water</li></ul>
<aside class="ad"><p>Buy the best ovens today at half the price!</p></aside>
<blockquote>A slow dough is a good dough.</blockquote><p>Bake it for forty minutes. Let it cool before you cut it.</p></article></main>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Great recipe, thank you so much for sharing it with us!</p></div></section>
<footer><p>Copyright 2021 Kitchen Notes. All rights reserved.</p></footer><script>var x = "<p>no</p>";</script></body></html>""",
        "Bread at home\nGood bread doesn't need a machine. It takes flour, water, salt & time, and an oven that gets hot.\n"
        "Mix the flour and the water in the evening. Leave the dough in a cool place until the morning, then fold it three times.\n"
        "500 g of flour\n350 g of water\nA slow dough is a good dough.\nBake it for forty minutes. Let it cool before you cut it.",
    ),
    (
        """<html><body><div id="header"><a href=/>The Daily</a></div><div class="menu"><a href=/w>World</a> <a href=/s>Sport</a></div>
<div class="content"><h1>River rises after a week of rain</h1><p>The river rose by two metres on Monday, the town said. Some streets near the old bridge are closed.</p>
<p>Schools stay open.<br>Buses run as usual, but for line four.<p>The water is expected to fall by the end of the week.</p>
<table><tr><td>Monday</td><td>2.1 m</td></tr></table></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Ten tips for the garden</a></li><li><a href=/2>Who won the cup</a></li></ul></div>
<form action=/n><label>Your e-mail</label><input name=e><p>Sign up for our newsletter and never miss a story again.</p></form>
<div id="footer">Contact | Imprint | Privacy</div></body></html>""",
        "River rises after a week of rain\nThe river rose by two metres on Monday, the town said. Some streets near the old bridge are closed.\n"
        "Schools stay open. Buses run as usual, but for line four.\nThe water is expected to fall by the end of the week.\nMonday\n2.1 m",
    ),
    (
        """<nav><a href=/a>A</a><a href=/b>B</a></nav><article><h2>On sums</h2><p>The sum of the first n odd numbers is <math><msup><mi>n</mi><mn>2</mn></msup></math>, as a square shows.</p>
<noscript><p>A picture of the square with its rows of dots would stand here, one row for each of the odd numbers.</p></noscript><pre>1 + 3 + 5
= 9</pre></article><footer>end of page</footer>""",
        "On sums\nThe sum of the first n odd numbers is n2, as a square shows.\nA picture of the square with its rows of dots would stand here, one row for each of the odd numbers.\n1 + 3 + 5 = 9",
    ),
]


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.train([r[1] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").orderBy("page_id").limit(100).collect()])


@pytest.mark.parametrize("page, want", HAND)
def test_html_pages_written_by_hand(labeller, page, want):
    assert html_text.extract(labeller, [page]) == [want]


def test_html_long_page(labeller):
    page = "<nav><a href=/>x</a></nav><article>" + "".join(f"<p>block {i} of a long page, with some words.</p>" for i in range(5000)) + "</article>"
    own = html_text.blocks(page)
    assert np.allclose(labeller.label([own], 300)[0], labeller.label([own], 10**9)[0], atol=1e-5)


def test_html_sample_does_not_depend_on_the_order_of_rows(spark):
    rows_ = [(7, "u", f"<article><p>text number {i} of one id</p></article>") for i in range(40)] + [(8, "v", "<article><p>other text</p></article>")]
    ends = []
    for own in (rows_, rows_[::-1]):
        frame = spark.createDataFrame(own, "page_id long, url string, html string").repartition(3)
        ends.append(sorted(map(tuple, html_text.main_text(frame).collect())))
    assert ends[0] == ends[1] and len(ends[0]) == 41


def test_html_labels_articles(spark):
    pages = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    model = html_text.train(pages[:100])
    for page, text in zip(pages, html_text.extract(model, pages)):
        parsed = html_text.blocks(page)
        assert text == "\n".join(b.text for b, y in zip(parsed, html_text.weak_labels(parsed)) if y)
    rng = np.random.default_rng(123)
    texts = [b.text for p in pages[:50] for b in html_text.blocks(p)]
    right = total = 0
    for _ in range(100):
        page, main = html_text.poured(texts, rng)
        own = html_text.blocks(page)
        y = np.array([b.text.split()[0] in main for b in own])
        for b in own:
            b.text = b.text.split(" ", 1)[-1]
        right += ((model.label([own])[0] >= 0.5) == y).sum()
        total += len(y)
    assert right / total > 0.95


def test_html_edges(spark):
    frame = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "plain"), (4, "u", "<p>unclosed <b"), (4, "u", "<p>unclosed <b")], "page_id long, url string, html string")
    got = html_text.main_text(frame).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and {r["page_id"]: r["text"] for r in got}[1] == ""
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_shingle_hashes():
    texts = [b"", b" ", b"A b\tC\x0bd e f", "ÄB c".encode(), b"a b c d e f"]
    got = shingles.shingle_sets(texts, 5)
    assert [len(x) for x in got] == [0, 0, 2, 1, 2] and (got[2] == got[4]).all()
