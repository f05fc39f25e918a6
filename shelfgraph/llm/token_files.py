"""Token ids in binary files: concatenated ids, with Elias-Fano coded document boundaries.

A file holds consecutive documents in ascending id order::

    magic, header (bytes of an id, documents, leading null ids, ids, smallest document id)
    Elias-Fano sequence of the n + 1 boundaries
    Elias-Fano sequence of the document ids, less the smallest
    ids, little-endian, 2 bytes each if the vocabulary allows and else 4

An Elias-Fano sequence takes about 2 + log2(range / n) bits a value. ``EliasFano.select`` finds single values through a
directory of 32-bit ranks, one for each 512 bits; no table of 64-bit offsets is stored or built.

Documents are range-sorted by id, tokenised where they land, and written in files of bounded size; the job returns a
manifest. A repeated task writes new files, and only files in the manifest are read.

Defined results: null text is empty and has only the end id. Null document ids come first. Rows that repeat are separate
documents (ties are ordered by text). An empty table gives no files and an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgraph.llm.storage import open_store, shared_folder, unique_name
from shelfgraph.llm.text import Chunk, RangeKeys, chunks
from shelfgraph.llm.word_cache import WordCache, per_row
from shelfgraph.session import staged

MAGIC = b"IDS+EF01"
HEADER = struct.Struct("<8sIQQQq")
END_ID = 1
FILE_IDS = 4_000_000
BLOCK = 512  # bits a rank of the directory covers
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:#$%&*")] = True
_ACCENTED = np.zeros(256, bool)  # second bytes of the letters U+00C0..U+00FF
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class EliasFano:
    """A sequence of non-decreasing numbers: low bits packed, high bits in unary, and a 32-bit rank for each block."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        counts = np.bitwise_count(high).reshape(-1, BLOCK // 8).sum(1)
        self.ranks = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            parts = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 1 if n else 1) // BLOCK) * BLOCK
        flags = np.zeros(size, np.uint8)
        flags[at] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"))

    def _low(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        for k in range(self.low_bits):
            bit = index * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << k
        return out

    def select(self, index) -> np.ndarray:
        """The values at the given places."""
        index = np.atleast_1d(np.asarray(index, np.int64))
        block = np.searchsorted(self.ranks, index, "right") - 1
        rows = self.high.reshape(-1, BLOCK // 8)[block]
        seen = np.cumsum(np.unpackbits(rows, axis=1, bitorder="little"), axis=1, dtype=np.int32)
        inside = np.argmax(seen > (index - self.ranks[block])[:, None], axis=1)
        return ((block * BLOCK + inside - index) << self.low_bits) | self._low(index)

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        return (high << self.low_bits) | self._low(np.arange(self.n))

    def to_bytes(self) -> bytes:
        return struct.pack("<QIQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, stream) -> EliasFano:
        n, bits, low, high = struct.unpack("<QIQQ", stream.read(28))
        return cls(n, bits, np.frombuffer(stream.read(low), np.uint8), np.frombuffer(stream.read(high), np.uint8))


def _byte_letters() -> dict[int, str]:
    """The visible characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """Ids of texts from a tokenizer, each distinct word encoded once by the library.

    Texts are parted where the tokenizer parts them whatever stands around: at blanks and, at level 2, between a letter or digit and
    marks that its pattern never joins with one; words then go in lower case, as its normaliser does. The level is
    found by a probe; at level 0 a text is one word. Texts that may hold a special token (all begin with ``<|``) are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.cache = WordCache(self._encode_words)
        self.level, self.plain = 0, False
        probe = "ab, cd.ef\n12! GH \u00e9t\u00e9.\u00c9T\u00c9, don't x-y 3.14 a&b"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        added = self.tokenizer.get_added_tokens_decoder().values()
        if all(t.content.startswith("<|") and not any(c in t.content for c in " \t\r\n") for t in added):
            self.level = next((k for k in (2, 1) if whole == [i for w in self._parts(probe, k) for i in self._by_library([w])[0]]), 0)
        words = ["the", "\u00e9tre", "enonth"]
        self.plain = self.level == 2 and [self._by_model(w) for w in words] == self._by_library(words)

    def _by_library(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _by_model(self, word: str) -> list[int]:
        """A word of plain lower-case letters needs no normalising and is one piece: the library's model alone does."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        easy = [self.plain and _PLAIN.fullmatch(w) is not None for w in words]
        rest = iter(self._by_library([w for w, e in zip(words, easy, strict=True) if not e]))
        got = [self._by_model(w) if e else next(rest) for w, e in zip(words, easy, strict=True)]
        return np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        solid = ~((data == 32) | (data == 9) | (data == 10) | (data == 13))
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] = solid[inner]
        if level == 2 and len(data) > 1:
            mark, before, after = _MARK[data], _LETTER[data], _LETTER[data]
            before[1:] |= _ACCENTED[data[1:]] & (data[:-1] == 0xC3)
            after[:-1] |= _ACCENTED[data[1:]] & (data[:-1] == 0xC3)
            begin[1:] |= (before[:-1] & mark[1:]) | (mark[:-1] & after[1:])
        start = np.flatnonzero(begin)
        stop = np.zeros(len(data) + 1, bool)
        stop[1:-1] = solid[:-1] & (~solid[1:] | begin[1:])
        stop[-1] = solid[-1]
        return start, np.flatnonzero(stop)

    def _parts(self, text: str, level: int) -> list[str]:
        raw = text.encode().translate(_ASCII_LOWER) if level == 2 else text.encode()
        data = np.frombuffer(raw, np.uint8)
        return [raw[a:b].decode() for a, b in zip(*self._cuts(data, np.array([0, len(data)]), level), strict=True)]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, and how many each text has."""
        raw = chunk.data.tobytes()
        if b"<|" in raw or not self.level:
            at = chunk.offsets.tolist()
            got = self._by_library([raw[a:b].decode() for a, b in zip(at, at[1:])])
            return np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64)
        if not raw:
            return np.zeros(0, np.int64), np.zeros(chunk.n, np.int64)
        raw = raw.translate(_ASCII_LOWER) if self.level == 2 else raw
        data = np.frombuffer(raw, np.uint8)
        start, end = self._cuts(data, chunk.offsets, self.level)
        ids, sizes = self.cache.encode(RangeKeys(data)(start, end), lambda k: [raw[a:b].decode() for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)])
        return ids, per_row(sizes, np.searchsorted(start, chunk.offsets))


_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def write_file(uri: str, ids: np.ndarray, sizes: np.ndarray, doc_ids: np.ndarray, n_null: int, width: int) -> None:
    """One file; ``doc_ids`` are those of the documents after the first ``n_null``, in ascending order."""
    low = int(doc_ids[0]) if len(doc_ids) else 0
    store, path = open_store(uri)
    with store.open_output_stream(path) as out:
        out.write(HEADER.pack(MAGIC, width, len(sizes), n_null, len(ids), low))
        out.write(EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)])).to_bytes())
        out.write(EliasFano.encode((doc_ids.astype(np.int64) - low)).to_bytes())
        out.write(np.ascontiguousarray(ids, f"<u{width}"))


class TokenFile:
    """A file opened for reading: whole, or one document at a time by its place."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.stream = store.open_input_file(path)
        magic, self.width, self.n, self.n_null, self.n_ids, self.low = HEADER.unpack(self.stream.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.bounds, self.names = EliasFano.read(self.stream), EliasFano.read(self.stream)
        self.begin = self.stream.tell()

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.names.values() + self.low).tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        self.stream.seek(self.begin + start * self.width)
        return np.frombuffer(self.stream.read((end - start) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.ids(*self.bounds.select([k, k + 1]).tolist())

    def close(self) -> None:
        self.stream.close()


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _writer(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, files = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        open_store(folder)[0].create_dir(open_store(folder)[1], recursive=True)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal files
            ids, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            known = np.array([x for x in names if x is not None], np.int64)
            uri = f"{folder}/{unique_name(f'{task:06d}-{files:06d}', '.ids')}"
            write_file(uri, ids, sizes, known, len(names) - len(known), width)
            row = pa.record_batch([pa.array([task]), pa.array([files]), pa.array([uri]), pa.array([len(sizes)]), pa.array([len(ids)])],
                                  schema=pa.schema([("task", pa.int64()), ("file", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            files += 1
            held.clear()
            names.clear()
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for chunk in chunks(texts):
                ids, sizes = encoder.encode(chunk)
                held.append((np.insert(ids, np.cumsum(sizes), end_id).astype(f"<u{width}"), sizes + 1))
                names.extend(doc_ids[chunk.first:chunk.first + chunk.n])
                if sum(len(h[0]) for h in held) >= file_ids:
                    yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
                      end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenise and write all documents; the manifest: (uri, n_docs, n_ids, start), files in document order.

    ``start`` is the number of ids in all files before. The files are written when this is called, not later.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    written = staged(order.mapInArrow(_writer(folder, tokenizer, end_id, file_ids), "task long, file long, uri string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("task", "file")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(uri)
            bounds, names = file.bounds.values(), file.doc_ids()
            for first in range(0, file.n, 4096):
                last = min(first + 4096, file.n)
                ids = file.ids(int(bounds[first]), int(bounds[last])).astype("<u4")
                cut = (bounds[first:last + 1] - bounds[first]).tolist()
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.record_batch([pa.array(names[first:last], pa.int64()), pa.array(bounds[first:last] + base),
                                       pa.array(np.diff(bounds[first:last + 1])), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
            file.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, read back from the files of a manifest."""
    files = manifest.select("uri", "start").repartition("uri")
    return files.mapInArrow(_read_rows, "id long, start long, n_tokens long, ids_crc32 long")


def document_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(id, ids) of each document, for a reader that wants the tokens themselves."""
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file = TokenFile(uri)
                for k, name in enumerate(file.doc_ids()):
                    yield pa.record_batch([pa.array([name], pa.int64()), pa.array([file.document(k).tolist()], pa.list_(pa.int64()))], ["id", "ids"])
                file.close()

    return manifest.select("uri").repartition("uri").mapInArrow(run, "id long, ids array<long>")
