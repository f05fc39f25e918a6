"""Removal of byte strings that also start elsewhere in the corpus, from merged Burrows-Wheeler transforms.

Which suffixes have to be compared at all is settled first, exactly:

1. Every window of ``width`` bytes has a smallest 32-byte gram (by hash); neighbouring windows with theirs in one place form a segment.
   Equal windows have equal smallest grams, so they lie in segments of one class. Two small numbers per segment are shuffled, not text.
2. Classes met once hold nothing that repeats. Equal segments of a class are counted as one with its multiplicity; a segment met
   twice is a repeated interval as a whole. What is left are classes with several different segments (edges of copied passages,
   places where copies were edited): their segments, once each, go on with their text.
3. A task takes whole classes, splits their segments into shards and builds each shard's transform. The transforms are merged by
   refining the interleave: rows of all shards start ordered by their first symbol, and each round orders the rows of a block by the
   blocks that their suffixes ``depth`` symbols on lie in, which doubles the depth that is settled. Only rows in blocks of several are touched;
   the order inside a shard is never sorted again. The round that parts two neighbours gives their common prefix; after the last round
   a block is an interval of suffixes with ``width`` symbols in common, repeated if its multiplicities add up to two or more.

A class with more text than ``CLASS_BYTES`` (a passage that very many documents continue differently) does not go to one task: its windows are keyed and
counted by a plain aggregation, with partial sums.

Defined results: null text is empty. Texts shorter than ``width`` keep all bytes. Matches never cross rows; rows equal in id and
text are two rows and so repeat each other. An empty table gives an empty result. Only the id and text columns are read. A task
needs about 100 bytes of memory for each byte of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.text import RangeKeys, chunks, mix
from shelfgraph.session import staged

WIDTH = 200
GRAM = 32
SHARDS = 4
BATCH_BYTES = 2 << 20
CLASS_BYTES = 6 << 20


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1:n])


def segments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, class key, content key) of all segments; windows do not leave their row.

    The windows of a segment share one place of their smallest gram (the first, if it comes twice), so no two of them are equal.
    """
    gram = min(GRAM, width)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    keys = RangeKeys(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(keys.raw(at, at + gram))
    least = _sliding_min(grams, width - gram + 1)
    inside = np.zeros(len(data) + 1, np.int64)
    size = np.diff(offsets)
    long_ = size >= width
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - width + 1, -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[:len(least) - 1] == least[1:])
    begin[offsets[:-1][long_]] = True
    stop = np.zeros(len(least) + 1, bool)
    stop[1:-1] = valid[:-1] & (~valid[1:] | begin[1:])
    stop[-1] = valid[-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    return first, last - first, least[first], keys(first, last + width - 1)


class Transform(NamedTuple):
    """A shard's transform. Symbols: 0 ends the shard, 1 ends a segment, a byte b is b + 2. ``place`` is each row's position in the shard."""

    symbols: np.ndarray
    place: np.ndarray


def _refine(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in key order (equal keys keep their order), and which of them begin a new key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(rows), bool)
    new[1:] = key[1:] != key[:-1]
    return rows[order], new


def transform(text: np.ndarray) -> Transform:
    """The transform of one shard's symbols (the last is 0), by suffix doubling over the suffixes that are not yet apart."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(6, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | padded[k:k + n]
    order, new = _refine(np.arange(n), key)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    depth = 7
    while True:
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        at = order[rows]
        order[rows], begins = _refine(at, rank[at] * (n + 1) + rank[np.minimum(at + depth, n)] + 1)
        new[rows] = begins
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[rows]] = head[rows]
        depth *= 2
    return Transform(text[order - 1].astype(np.uint16), order)


class Merged(NamedTuple):
    rows: np.ndarray      # rows of the shards, laid end to end, in merged order
    starts: np.ndarray    # where a block of equal prefixes of the full width begins
    common: np.ndarray    # settled common prefix of each row with the one before: a power of two it reaches, or the width


def merge(transforms: list[np.ndarray], width: int = WIDTH) -> Merged:
    """Interleave the rows of several transforms by their first ``width`` symbols, from the transforms alone."""
    base = np.cumsum([0, *(len(t) for t in transforms)])
    n = int(base[-1])
    after = np.concatenate([np.argsort(t, kind="stable") + b for t, b in zip(transforms, base, strict=False)])  # the row of the suffix one symbol on
    symbols = np.concatenate(transforms)
    rows, new = _refine(np.arange(n), symbols[after].astype(np.int64))
    common = np.zeros(n, np.int64)
    block = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    block[rows] = head

    def round_(jump: np.ndarray, reached: int) -> None:
        """Part the blocks by the blocks of the suffixes that ``jump`` leads to."""
        nonlocal head
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            return
        held = rows[open_]
        old = new[open_]
        rows[open_], begins = _refine(held, head[open_] * n + block[jump[held]])
        new[open_] = begins
        common[open_[begins & ~old]] = reached
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        block[rows[open_]] = head[open_]

    depth, jump = 1, after
    rest, ahead = width - (1 << (width.bit_length() - 1)), None
    while depth * 2 <= width:
        round_(jump, depth)
        if rest & depth:
            ahead = jump if ahead is None else jump[ahead]
        jump = jump[jump]
        depth *= 2
    if ahead is not None:
        round_(ahead, depth)
    common[~new] = width
    return Merged(rows, new, common)


def repeated_windows(texts: list[bytes], copies: list[int], width: int = WIDTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each text, a flag for each of its windows: the window's string starts at two or more places of all texts and their copies."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    cuts = np.unique(np.searchsorted(first, np.linspace(0, first[-1], max(1, min(shards, len(texts))) + 1)[1:-1]))
    groups = [g for g in np.split(np.arange(len(texts)), cuts) if len(g)]
    built, owner, place = [], [], []
    for group in groups:
        symbols = np.frombuffer(b"\x00".join(texts[i] for i in group) + b"\x00\x00", np.uint8).astype(np.uint16) + 2
        ends = np.cumsum(size[group] + 1) - 1
        symbols[ends], symbols[-1] = 1, 0
        shard = transform(symbols)
        built.append(shard.symbols)
        which = np.minimum(np.searchsorted(ends, shard.place), len(group) - 1)
        owner.append(group[which])
        place.append(shard.place - (ends[which] - size[group][which]))
    merged = merge(built, width)
    owner, place = np.concatenate(owner)[merged.rows], np.concatenate(place)[merged.rows]
    real = (place >= 0) & (place + width <= size[owner])
    block = np.cumsum(merged.starts) - 1
    weight = np.bincount(block[real], weights=np.array(copies, np.float64)[owner[real]], minlength=int(block[-1]) + 1)
    again = real & (weight[block] >= 2)
    out = [np.zeros(max(0, int(s) - width + 1), bool) for s in size]
    flat = np.concatenate([[0], np.cumsum([len(o) for o in out])])
    flags = np.zeros(int(flat[-1]), bool)
    flags[flat[owner[again]] + place[again]] = True
    return [flags[a:b] for a, b in zip(flat, flat[1:])]


def flag_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _segment_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                first, count, group, content = segments(chunk.data, chunk.offsets, width)
                row = np.searchsorted(chunk.offsets, first, "right") - 1
                take = pa.array(row + chunk.first)
                yield pa.record_batch([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array((first - chunk.offsets[row]).astype(np.int32)),
                    pa.array(count.astype(np.int32)), pa.array(group.view(np.int64)), pa.array(content.view(np.int64)),
                ], ["id", "text_key", "at", "n", "class", "content"])

    return run


def _text_rows(width: int):
    """The text of the segments asked for of each document."""
    schema = pa.schema([("class", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, key, text, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, id_, key = text.as_py().encode(), id_.as_py(), key.as_py()
                rows = [(a["class"], a["content"], a["copies"], id_, key, a["at"], raw[a["at"]:a["at"] + a["n"] + width - 1]) for a in asked.as_py()]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return run


_SPAN = "id long, text_key long, start int, end int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    ids, keys, start, end = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "text_key", "start", "end"])


def _merge_rows(width: int, shards: int):
    """Whole classes, gathered to batches of bounded size: spans of the segments that occur once."""
    def solve(held: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([h[6] for h in held], [h[2] for h in held], width, shards)
        return _spans([(h[3], h[4], h[5] + a, h[5] + b + width - 1) for h, f in zip(held, flags, strict=True) if h[2] == 1 for a, b in flag_runs(f)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size >= BATCH_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(6).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                first = np.arange(len(data) - width + 1)
                keys = RangeKeys(data)(first, first + width)
                one = batch.slice(i, 1).take(pa.array(np.zeros(len(first), np.int64)))
                at = np.asarray(one.column(5)) + first
                yield pa.record_batch([one.column(0), pa.array(keys.view(np.int64)), one.column(2), one.column(3), one.column(4), pa.array(at.astype(np.int32))],
                                      ["class", "window", "copies", "id", "text_key", "at"])

    return run


def repeated_spans(rows: DataFrame, width: int = WIDTH, shards: int = SHARDS, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(id, text_key, start, end) of repeated stretches of (id, text_key, text) rows; stretches of a row may overlap."""
    found = staged(rows.mapInArrow(_segment_rows(width), "id long, text_key long, at int, n int, class long, content long"), "segments")
    often = found.groupBy("class").agg(F.count("*").alias("c")).filter("c > 1").select("class")
    found = staged(found.join(often, "class", "left_semi"), "shared-segments")
    kinds = found.groupBy("class", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_key", "at", "n")).alias("one"))
    kinds = staged(kinds, "segment-kinds")

    whole = kinds.filter("copies > 1").select(F.col("class").alias("c"), F.col("content").alias("k"))
    whole = found.join(whole, (F.col("class") == F.col("c")) & (F.col("content") == F.col("k"))).select(
        "id", "text_key", F.col("at").alias("start"), (F.col("at") + F.col("n") + (width - 1)).alias("end"))

    mixed = kinds.groupBy("class").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"), F.sum(F.col("one.n") + (width - 1)).alias("bytes"))
    mixed = mixed.filter("kinds > 1 and least = 1").select("class", (F.col("bytes") > class_bytes).alias("large"))
    asked = kinds.join(mixed, "class").select("class", "content", "copies", "large", "one.*")
    by_text = asked.groupBy("id", "text_key").agg(F.collect_list(F.struct("class", "content", "copies", "at", "n", "large")).alias("asked"))
    by_text = by_text.select(F.col("id").alias("i"), F.col("text_key").alias("t"), "asked")
    texts = rows.join(by_text, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t"))).select("id", "text_key", "text", "asked")
    fetched = texts.mapInArrow(_text_rows(width), "class long, content long, copies long, id long, text_key long, at int, text binary").dropDuplicates(["class", "content"])
    fetched = staged(fetched.join(mixed.withColumnRenamed("class", "c"), F.col("class") == F.col("c")).drop("c"), "segment-texts")

    columns = ["class", "content", "copies", "id", "text_key", "at", "text"]
    some = fetched.filter("not large").select(*columns).repartition("class").sortWithinPartitions("class").mapInArrow(_merge_rows(width, shards), _SPAN)
    windows = fetched.filter("large").select(*columns).mapInArrow(_window_rows(width), "class long, window long, copies long, id long, text_key long, at int")
    again = windows.groupBy("class", "window").agg(F.sum("copies").alias("c")).filter("c > 1").select(F.col("class").alias("wc"), F.col("window").alias("ww"))
    many = windows.filter("copies = 1").join(again, (F.col("class") == F.col("wc")) & (F.col("window") == F.col("ww"))).select(
        "id", "text_key", F.col("at").alias("start"), (F.col("at") + width).alias("end"))
    return whole.unionByName(some).unionByName(many)


def _removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
            raw, kept, at, removed, count = text.as_py().encode(), hashlib.sha256(), 0, 0, 0
            found = spans.values if spans.is_valid else None
            if found is not None and len(found):
                start, end = np.asarray(found.field("start")), np.asarray(found.field("end"))
                order = np.argsort(start)
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.append(True, start[1:] > end[:-1])
                for a, b in zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist(), strict=True):
                    kept.update(raw[at:a])
                    at, removed, count = b, removed + b - a, count + 1
            kept.update(raw[at:])
            out.append((id_.as_py(), len(raw), removed, count, kept.hexdigest()))
        ids, size, removed, count, digest = zip(*out, strict=True) if out else ((),) * 5
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                              ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("text").alias("text_key"), "text")


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, text, spans) of each row; spans is an array of (start, end) byte places, or null."""
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, width).groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("id").alias("i"), F.col("text_key").alias("t"), "spans")
    return rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")), "left").select("id", "text", "spans")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return with_spans(docs, id_col, text_col, width).mapInArrow(_removal_rows, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
