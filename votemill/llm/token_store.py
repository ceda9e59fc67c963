"""Token ids in binary shards: independent zstandard frames, checksums, and a trailing seek table.

A shard holds, one after the other:
  data frames   each a zstandard frame with the ids (little-endian, 2 or 4 bytes) of consecutive documents
  directory     a zstandard frame: a validity byte, the int64 id and the uint64 token count of every document
  seek table    a skippable frame: compressed size, raw size, documents and CRC-32 of every data frame, then
                the same of the directory, the number of frames and the bytes of an id
The file is therefore a valid zstandard stream, and a reader that has the seek table decompresses only the
frames of the documents it was asked for.

Edge cases: a null text is an empty one (it still gets its end id); a null id sorts first; rows with the same
id are all kept, in no fixed order among each other unless their texts differ (then by text); an empty table
gives no shard and no row; extra columns are ignored. Frames hold whole documents, however long.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.bpe import WordBpe, parts
from votemill.llm.common import in_batches, materialize, scratch_path

SKIPPABLE = 0x184D2A5E
ENTRY = struct.Struct("<QQQI")
TAIL = struct.Struct("<QQQIQBI")
FRAME_IDS = 1 << 16
#: New words in one text for the library; rows and bytes that are encoded at once, and words of the memo.
MARKED = 2000
ENCODE_ROWS, ENCODE_BYTES, MEMO_WORDS = 8000, 16 << 20, 800_000


class LibraryBpe(WordBpe):
    """The tokenizers library as encoder, behind a memo of words.

    The vocabulary cuts texts at white space before it merges, so a word has the same ids in every text. New
    words go to the library many in one text, a special token between them to tell their ids apart.
    """

    memo_words = MEMO_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.size = self.library.get_vocab_size()
        self.forget()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None or any("<|" in w for w in words):
            ids = [self.library.encode(w, add_special_tokens=False).ids for w in words]
            return np.array(list(chain.from_iterable(ids)), np.int32), np.array(list(map(len, ids)), np.int64)
        texts = [self.mark.join([*words[i : i + MARKED], ""]) for i in range(0, len(words), MARKED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        end = ids == self.mark_id
        return ids[~end], np.diff(np.flatnonzero(end), prepend=-1) - 1


@lru_cache(2)
def library(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class ShardWriter:
    def __init__(self, sink, width: int):
        self.sink, self.kind = sink, np.dtype("<u2" if width == 2 else "<u4")
        self.zip = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.size = self.tokens = self.docs = 0

    def add(self, doc_ids: list[int | None], flat: np.ndarray, off: np.ndarray) -> None:
        """Documents with their ids in one array; a frame ends with the document that brings it to FRAME_IDS."""
        counts = np.diff(off)
        self.ids += doc_ids
        self.counts += counts.tolist()
        flat, at = flat.astype(self.kind), 0
        self.tokens += len(flat)
        while at < len(counts):
            end = int(np.searchsorted(off, off[at] + max(FRAME_IDS - self.size, 1)))
            full, end = end < len(off), min(end, len(counts))
            self.waiting.append(flat[off[at] : off[end]])
            self.docs, self.size = self.docs + end - at, self.size + int(off[end] - off[at])
            if full:
                self._flush()
            at = end

    def _frame(self, raw: bytes, docs: int) -> tuple[int, int, int, int]:
        packed = self.zip.compress(raw)
        self.sink.write(packed)
        return len(packed), len(raw), docs, zlib.crc32(raw)

    def _flush(self) -> None:
        if self.docs:
            self.frames.append(self._frame(np.concatenate(self.waiting).tobytes(), self.docs))
            self.waiting, self.size, self.docs = [], 0, 0

    def close(self) -> None:
        self._flush()
        valid = np.array([i is not None for i in self.ids], np.uint8)
        own = np.array([i or 0 for i in self.ids], "<i8")
        directory = self._frame(valid.tobytes() + own.tobytes() + np.array(self.counts, "<u8").tobytes(), len(self.ids))
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + TAIL.pack(*directory, len(self.frames), self.kind.itemsize, SKIPPABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class ShardReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TAIL.size)
        packed, raw, docs, crc, frames, width, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != SKIPPABLE:
            raise ValueError("not a token shard")
        at = size - TAIL.size - frames * ENTRY.size
        source.seek(at)
        table = source.read(frames * ENTRY.size)
        self.frames = [ENTRY.unpack_from(table, i * ENTRY.size) for i in range(frames)]
        self.kind = np.dtype(f"<u{width}")
        data = self._open(at - 8 - packed, packed, raw, crc)
        valid = np.frombuffer(data[:docs], np.uint8)
        own = np.frombuffer(data[docs : 9 * docs], "<i8").tolist()
        self.ids = [i if v else None for i, v in zip(own, valid)]
        self.counts = np.frombuffer(data[9 * docs :], "<u8").astype(np.int64)
        self.first = np.cumsum([0, *(f[2] for f in self.frames)])
        self.offset = np.cumsum([0, *(f[0] for f in self.frames)])

    def _open(self, at: int, packed: int, raw: int, crc: int) -> bytes:
        self.source.seek(int(at))
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(raw, 1))
        if len(data) != raw or zlib.crc32(data) != crc:
            raise ValueError("a frame of a token shard is damaged")
        return data

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """Id and token ids of each document of frame k."""
        packed, raw, docs, crc = self.frames[k]
        ids = np.frombuffer(self._open(self.offset[k], packed, raw, crc), self.kind)
        a = int(self.first[k])
        cut = np.cumsum([0, *self.counts[a : a + docs]])
        for i in range(docs):
            yield self.ids[a + i], ids[cut[i] : cut[i + 1]]

    def document(self, n: int) -> np.ndarray:
        """Token ids of the n-th document of the shard; only its frame is decompressed."""
        k = int(np.searchsorted(self.first, n, "right")) - 1
        return next(ids for i, (_, ids) in enumerate(self.frame(k)) if i == n - self.first[k])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append end_id and write in ascending order of id (then of a hash of the text), a shard a range of it. Returns one row a shard.

    A shard's name is unique to the attempt that wrote it; only those of attempts that finished are listed.
    """

    def run(batches):
        bpe, sink, shard = library(tokenizer), None, TaskContext.get().partitionId()
        width = 2 if bpe.size <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if sink is None and keys:
                fs, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}.tok"
                sink = fs.open_output_stream(f"{root}/{name}")
                out = ShardWriter(sink, width)
            for a, texts in parts(batch.column(1), ENCODE_ROWS, ENCODE_BYTES):
                flat, off = bpe.encode_column(texts)
                out.add(keys[a : a + len(texts)], np.insert(flat, off[1:], end_id), off + np.arange(len(off)))
        if sink is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [len(out.ids)], "n_tokens": [out.tokens]})

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.withColumns({"hash_": F.xxhash64("text"), "row_": F.monotonically_increasing_id()})  # equal ids, and equal rows, lie in many shards
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash_"), F.col("row_")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(in_batches(ordered, run, "shard int, name string, n_docs long, n_tokens long", ENCODE_ROWS), "shards")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens and the CRC-32 of its ids."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, root = filesystem(folder)
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = ShardReader(source)
                    for k in range(len(reader.frames)):
                        rows = []
                        for doc_id, ids in reader.frame(k):
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One small row a shard, so a running sum over all of them is cheap.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    plan = shards.select("shard", "name", F.coalesce(before, F.lit(0)).alias("start"))
    plan = plan.repartition(max(1, shards.count()), "shard").select("name", "start")
    return in_batches(plan, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, os.fspath(folder), tokenizer, end_id), os.fspath(folder))
