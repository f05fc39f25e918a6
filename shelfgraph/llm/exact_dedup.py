"""Exact duplicates by a cuckoo-filter index over content digests.

Each task hashes its texts and adds up equal ones before anything is shuffled, so a text that fills a third of the
table leaves each task as one row. Digests are then dealt by value; each partition keeps its live digests in a
``CuckooIndex`` (a few bytes a slot) and the stored keys next to the slots.

Defined results: null text is empty text. Null ids rank below all others. Rows that agree in id and text are copies of
each other, and one of them stays. An empty table gives an empty result. Only the id and text columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.text import chunks
from shelfgraph.session import staged

SLOTS = 4
MAX_KICKS = 200
_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints whose slots point at the stored keys.

    A lookup reads the two buckets of a digest; a slot with its fingerprint is only a hit when the key stored for that
    slot is the same (whole digest and length). Deleting frees the slot. When an insertion moves too many
    fingerprints about, the table doubles and is filled again from the stored live keys.
    """

    def __init__(self, buckets: int = 1024):
        self.keys: list[tuple | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: tuple) -> int:
        """The slot of a live key, or -1: fingerprints first, then the stored key itself."""
        mark, one, two = self._places(key[0])
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.keys[self.refs[at]] == key:
                    return at
        return -1

    def get(self, key: tuple):
        at = self._slot(key)
        return None if at < 0 else self.values[self.refs[at]]

    def insert(self, key: tuple, value) -> None:
        ref = self.free.pop() if self.free else len(self.keys)
        if ref == len(self.keys):
            self.keys.append(key)
            self.values.append(value)
        else:
            self.keys[ref], self.values[ref] = key, value
        if not self._place(ref):
            self._grow()

    def _place(self, ref: int) -> bool:
        mark, bucket, two = self._places(self.keys[ref][0])
        for turn in range(MAX_KICKS):
            for place in (bucket, two) if turn == 0 else (bucket,):
                for at in range(place * SLOTS, place * SLOTS + SLOTS):
                    if not self.prints[at]:
                        self.prints[at], self.refs[at] = mark, ref
                        return True
            at = bucket * SLOTS + turn % SLOTS
            mark, self.prints[at] = self.prints[at], mark
            ref, self.refs[at] = self.refs[at], ref
            bucket = self._other(bucket, mark)
        return False

    def _grow(self) -> None:
        live = [r for r, key in enumerate(self.keys) if key is not None]
        size = self.mask + 1
        while True:
            self.resizes += 1
            size *= 2
            self._clear(size)
            if all(self._place(r) for r in live):
                return

    def delete(self, key: tuple) -> bool:
        at = self._slot(key)
        if at < 0:
            return False
        ref = self.refs[at]
        self.prints[at], self.keys[ref], self.values[ref] = 0, None, None
        self.free.append(ref)
        return True

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def items(self):
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = [], []
        for chunk in chunks(batch.column(1)):
            raw, at = chunk.data.tobytes().translate(_ASCII_LOWER), chunk.offsets.tolist()
            for a, b in zip(at, at[1:]):
                digests.append(hashlib.sha256(raw[a:b]).digest())
                sizes.append(b - a)
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["id", "digest", "n_bytes"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes): SHA-256 and length in bytes of each text, A-Z lower-cased."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _digest_rows, "id long, digest binary, n_bytes long")


def _merge(index: CuckooIndex, key: tuple, keep: int | None, size: int) -> None:
    """Add a group to the live digests: the entry with the smaller id is deleted, the larger id takes its place."""
    live = index.get(key)
    if live is not None:
        index.delete(key)
        keep, size = max((x for x in (live[0], keep) if x is not None), default=None), live[1] + size
    index.insert(key, (keep, size))


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    found = list(index.items())
    for at in range(0, len(found), 20_000):
        part = found[at:at + 20_000]
        yield pa.record_batch([
            pa.array([k[0] for k, _ in part], pa.binary()), pa.array([k[1] for k, _ in part], pa.int64()),
            pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64()),
        ], ["digest", "n_bytes", "keep_id", "group_size"])


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, n_bytes, keep, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            _merge(index, (digest, n_bytes), keep, size)
    yield from _rows(index)


def live_digests(rows: DataFrame) -> DataFrame:
    """(digest, n_bytes, keep_id, group_size) of the distinct texts among rows of ``digests``.

    The first pass runs where the rows lie, and leaves one row for each text and task; the second sees all rows of a digest.
    """
    schema = "digest binary, n_bytes long, keep_id long, group_size long"
    own = rows.select("digest", "n_bytes", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_index_rows, schema)
    return own.repartition("digest").mapInArrow(_index_rows, schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for each row: which row of its group of equal texts stays."""
    rows = staged(digests(docs, id_col, text_col), "digests")
    groups = live_digests(rows).withColumnRenamed("digest", "d").withColumnRenamed("n_bytes", "n")
    same = Window.partitionBy("id", "digest").orderBy("n_bytes")
    joined = rows.withColumn("copy", F.row_number().over(same)).join(groups, (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("n")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return joined.select("id", "digest", "n_bytes", "keep_id", "group_size", kept.alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    name = lambda id_, digest: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.lower(F.hex(digest)))
    keep = exact_duplicates(docs, id_col, text_col).filter("kept").select(name(F.col("id"), F.col("digest")).alias("_keep"))
    whole = docs.select(F.struct("*").alias("_row"))
    text = F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    found = whole.withColumn("_name", name(F.col(f"_row.`{id_col}`").cast("long"), digest)).join(keep, F.col("_name") == F.col("_keep"))
    one = Window.partitionBy("_name").orderBy(F.xxhash64("_row"))  # the join has dealt the rows by this name
    return found.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")
