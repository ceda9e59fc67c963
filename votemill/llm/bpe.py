"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round finds, by binary search over the
sorted pair keys, the rank of every adjacent pair, takes the lowest rank of each word, merges all its
occurrences at once and drops the words that have nothing left to merge.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; a null
doc_id is carried through; repeated rows are encoded each on their own; an empty table gives an empty
table; extra columns are ignored. Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from votemill.llm.common import in_batches

#: Characters of text that one slice of a column has, and words that the encoder's memo holds.
CHUNK_CHARS = 1_000_000
MEMO_WORDS = 300_000
#: Rows and bytes of text that the encoder takes at once: the more, the fewer distinct words.
ENCODE_ROWS, ENCODE_BYTES = 2000, 4 << 20
NO_PAIR = np.int64(1 << 62)
_STOPS = frozenset(".,;:!?")
#: Characters that are their own normal form and whose classes no version of Unicode changes.
_LATIN = re.compile("[\x21-\x7e\xa1-\u024f]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: A capital that the normal form may join to a mark; that comes before lower case, and some letters join in lower case only.
MARKED_CAPITAL = r"[A-Z]\p{M}"


class WordBpe:
    """A word-level BPE with word ends, read from a tokenizer's JSON description."""

    memo_words = MEMO_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.base = np.int64(size)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        # The library's normal form and classes alone, without its vocabulary.
        self.library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.byte_of = {c: i for i, c in enumerate(chars)}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.forget()

    def forget(self) -> None:
        """The memo: words between ASCII white space, and where their ids lie in one flat array."""
        self.known = pa.array([], pa.string())
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the memo's entries at, in one array, and where each entry ends."""
        size = self.lengths[at]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(total, len(self.flat)) < 1 << 31 else np.int64
        where = np.repeat((self.starts[at] - (upto - size)).astype(kind), size)
        where += np.arange(total, dtype=kind)
        return self.flat[where], upto

    def _find(self, words: pa.Array) -> np.ndarray:
        """The memo's entries of distinct words; new ones are learned. A full memo keeps those that are asked for now."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        if not len(new):
            return at.to_numpy()
        if len(self.known) and len(self.known) + len(new) > self.memo_words:
            here = at.drop_null().to_numpy()
            kept, (ids, _), lengths = words.filter(at.is_valid()), self._gather(here), self.lengths[here]
            self.known, self.flat, self.lengths = kept, ids, lengths
            self.starts = np.cumsum(lengths) - lengths
        ids, lengths = self.learn(new.to_pylist())
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        self.known = pa.concat_arrays([self.known, new])
        return pc.index_in(words, value_set=self.known).to_numpy()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has: cut to pieces, and each distinct piece merged once."""
        cut = [[w.lower()] if w.isascii() and w.isalpha() else self.pieces(w) for w in words]
        pieces = dict.fromkeys(chain.from_iterable(cut))
        plain = [p for p in pieces if p not in self.added]
        ids, lengths = self.merge_words([p.encode() for p in plain])
        special = [p for p in pieces if p in self.added]
        ids = np.concatenate([ids, np.array([self.added[p] for p in special], np.int32)])
        lengths = np.concatenate([lengths, np.ones(len(special), np.int64)])
        number = dict(zip(chain(plain, special), range(len(lengths))))
        at = np.array(list(map(number.__getitem__, chain.from_iterable(cut))), np.int64)
        size, starts = lengths[at], np.cumsum(lengths) - lengths
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        out = ids[np.arange(total) + np.repeat(starts[at] - (upto - size), size)]
        return out, np.diff(np.concatenate([[0], upto])[np.cumsum([0, *map(len, cut)])])

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        out_word, out_sym = [], []
        while len(sym):
            rank = np.full(len(sym), NO_PAIR)
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][found] = self.ranks[at[found]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            done = least == NO_PAIR
            if done.any():
                out_word.append(word[done])
                out_sym.append(sym[done])
                live = ~done
                sym, word, rank, least = sym[live], word[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = rank == least
            # In a run of overlapping equal pairs, every second one merges, from the left.
            pos = np.arange(len(sym))
            fresh = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.maximum.accumulate(np.where(fresh, pos, 0))
            hit &= (pos - run) % 2 == 0
            sym[hit] = self.merged[rank[hit]]
            stay = ~np.concatenate([[False], hit[:-1]])
            sym, word = sym[stay], word[stay]
        if not out_word:
            return np.zeros(0, np.int32), lengths
        word, sym = np.concatenate(out_word), np.concatenate(out_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def pieces(self, word: str) -> list[str]:
        """A word cut as the vocabulary cuts it; special tokens stay whole."""
        if "<|" in word and self.special.search(word):
            out, at = [], 0
            for m in self.special.finditer(word):
                out += self.plain(word[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self.plain(word[at:])
        return self.plain(word)

    def plain(self, word: str) -> list[str]:
        """Pieces without special tokens. The library's own normal form and classes cut words beyond Latin letters."""
        if word[-1:] in _STOPS and word[:-1].isascii() and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1]]
        if _LATIN.fullmatch(word):
            return self.words.findall(word.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in found]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) in one array, and the offsets at which each text starts and the last ends.

        No piece reaches over ASCII white space, so equal words have equal ids in every text.
        """
        texts = pc.fill_null(column, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told apart by case
            marked = pc.match_substring_regex(texts, MARKED_CAPITAL)
            texts = pc.if_else(marked, texts, pc.ascii_lower(texts)) if pc.any(marked).as_py() else pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        at = self._find(coded.dictionary)
        ids, upto = self._gather(at[coded.indices.to_numpy()])
        return ids, np.concatenate([[0], upto])[words.offsets.to_numpy()]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Tokens joined by one space: these vocabularies come without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a column's texts (null as empty) and the texts: some hundred rows and about limit characters at a time."""
    for row in range(0, len(column), 512):
        texts = [t or "" for t in column.slice(row, 512).to_pylist()]
        for a, b in chunks(texts, limit):
            yield row + a, row + b, texts[a:b]


def parts(column: pa.Array, rows: int = ENCODE_ROWS, limit: int = ENCODE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """A column of texts in slices of at most rows rows and about limit bytes, one row at least, and where each begins."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(upto, upto[a] - size[a] + limit, "right"))
        b = min(max(b, a + 1), a + rows)
        yield a, column.slice(a, b - a)
        a = b


def token_slices(off: np.ndarray, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit tokens, one text at least."""
    a = 0
    while a < len(off) - 1:
        b = max(int(np.searchsorted(off, off[a] + limit, "right")) - 1, a + 1)
        yield a, b
        a = b


def joined(tokens: pa.Array, flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """Of each text, its tokens' strings joined by one space."""
    lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), tokens.take(pa.array(flat)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def sha256(texts: pa.Array) -> pa.Array:
    _, off, data = texts.buffers()
    off, data = np.frombuffer(off, np.int64)[texts.offset :].tolist(), memoryview(data or b"")
    return pa.array([hashlib.sha256(data[off[i] : off[i + 1]]).hexdigest() for i in range(len(texts))], pa.string())


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row a document: its id, ids (array) and decoded text; with digests, their counts and SHA-256 instead.

    Tokens are decoded joined by one space: these vocabularies come without a decoder.
    """
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(tokenizer)
        tokens = pa.array(bpe.tokens, pa.large_string())
        numbers = pa.array([str(i) for i in range(len(bpe.tokens))], pa.large_string())
        for batch in batches:
            keys = batch.column(0)
            for a, texts in parts(batch.column(1)):
                every, upto = bpe.encode_column(texts)
                for b, e in token_slices(upto):
                    flat, off = every[upto[b] : upto[e]], upto[b : e + 1] - upto[b]
                    decoded = joined(tokens, flat, off)
                    if digests:
                        made = [pa.array(np.diff(off), pa.int64()), sha256(joined(numbers, flat, off)), sha256(decoded)]
                        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                    else:
                        made = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32())), decoded.cast(pa.string())]
                        names = ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays([keys.slice(a + b, e - b), *made], names=[id_col, *names])

    return in_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {columns}", ENCODE_ROWS)
