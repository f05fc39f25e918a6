"""One large JSON document read by many tasks: the elements of its top-level arrays as rows.

Spark reads a file in blocks, here as pieces that end with ``}``, so a block begins outside of any escape. Whether it begins inside a string,
and how deep, follows from the blocks before it:

1. each task counts quotes and brackets of its blocks, under both assumptions about a string at their start;
2. sums over the blocks of a file, one small row each, give every block its start;
3. each task cuts its blocks at the commas of top-level arrays; only elements that reach over a block's end are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgraph.session import staged

QUOTE, BACKSLASH, COMMA = 34, 92, 44
OPEN, CLOSE = (91, 123), (93, 125)


class Marks:
    """The unescaped quotes of a stretch of text, and its brackets and commas that are outside of strings."""

    def __init__(self, data: np.ndarray, inside: bool):
        place = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(data != BACKSLASH, place, -1)) if len(data) else place
        before = np.concatenate([[-1], plain[:-1]]) if len(data) else place
        quotes = (data == QUOTE) & ((place - 1 - before) % 2 == 0)
        self.odd = int(quotes.sum()) % 2
        text = (np.cumsum(quotes) + inside) % 2 == 1
        step = np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE)
        self.at = np.flatnonzero(((step != 0) | (data == COMMA)) & ~text)
        self.step = step[self.at]
        self.sum = int(self.step.sum())


def runs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Runs of rows of one block, with the columns beside the text."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "value"]
        others = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
        values = batch.column(batch.schema.get_field_index("value")).cast(pa.binary()).to_pylist()
        a = 0
        for b in range(1, len(values) + 1):
            if b == len(values) or others[b] != others[a]:
                yield dict(zip(names, others[a])), values[a:b]
                a = b


def _bytes(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"}".join([*values, b""]), np.uint8)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, outside, inside, first): quotes, change of depth under either assumption, and the first bracket of a block."""
    state: dict[tuple[str, int], list] = {}
    for about, values in runs_of_blocks(batches):
        own = state.setdefault((about["file"], about["block"]), [0, 0, 0, None])
        data = _bytes(values)
        marks = [Marks(data, bool((own[0] + side) % 2)) for side in (0, 1)]
        if own[3] is None and (brackets := marks[0].at[marks[0].step != 0]).size:
            own[3] = chr(data[brackets[0]])
        own[1], own[2], own[0] = own[1] + marks[0].sum, own[2] + marks[1].sum, (own[0] + marks[0].odd) % 2
    rows = [(f, b, *s) for (f, b), s in state.items()]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "block", "odd", "outside", "inside", "first"])


class _Cutter:
    """Cuts one block: ``rows`` get (file, block, header, opens, element, left, right, text)."""

    def __init__(self, about: dict, rows: list):
        self.about, self.rows = about, rows
        self.odd, self.depth, self.base = about["odd"], about["depth"], about["base"]
        self.opens = self.element = 0
        self.left = about["block"] > 0
        self.text: list[bytes] = []

    def _emit(self, header: bool, right: bool) -> None:
        self.rows.append((self.about["file"], self.about["block"], header, self.opens, self.element, self.left, right, b"".join(self.text)))
        self.left, self.text = False, []

    def feed(self, values: list[bytes]) -> None:
        data = _bytes(values)
        raw = data.tobytes()
        marks = Marks(data, bool(self.odd))
        after = self.depth + np.cumsum(marks.step)
        level = np.maximum(after, after - marks.step) - self.base  # 0: around a header, 1: around or inside an array
        some = np.flatnonzero((level >= 0) & (level <= 1))
        at = 0
        for i in some.tolist():
            place, step, lvl, deep = int(marks.at[i]), int(marks.step[i]), int(level[i]), int(after[i] - marks.step[i]) - self.base
            if step == 0 and lvl == 0:
                continue
            if step > 0 and lvl == 1:                       # an array or object begins: its header ends
                self.text.append(raw[at:place + 1])
                self._emit(True, False)
                self.opens, self.element = self.opens + 1, 0
            elif step > 0:                                  # the document itself begins
                self.text = []
            elif lvl == 1:                                  # a comma, or the end of an array or object
                self.text.append(raw[at:place])
                self._emit(False, False)
                self.element += step == 0
            else:                                           # the document ends
                if deep >= 0:
                    self.text.append(raw[at:place])
                    self._emit(True, False)
            at = place + 1
        end = int(after[-1]) if len(after) else self.depth
        if end >= self.base:
            self.text.append(raw[at:])
        self.depth, self.odd = end, (self.odd + marks.odd) % 2

    def finish(self) -> None:
        if self.depth >= self.base:
            self._emit(self.depth == self.base, True)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["file", "block", "header", "opens", "element", "left", "right", "text"]
    rows: list[tuple] = []
    cutter = None
    for about, values in runs_of_blocks(batches):
        if cutter is None or cutter.about != about:
            if cutter is not None:
                cutter.finish()
            cutter = _Cutter(about, rows)
        cutter.feed(values)
        if len(rows) > 5_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
    if cutter is not None:
        cutter.finish()
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def put_together(parts: DataFrame, *keys: str) -> DataFrame:
    """The parts of a text that reaches over several blocks, put together in order."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


def cut(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(file, key, pos, text) of the elements of the arrays under some top-level keys; '' is a document that is an array itself.

    Of a repeated key the last array counts, as in a parser. Documents that are no JSON give no rows, or elements that do not parse.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counts = staged(pieces.mapInArrow(_count_rows, "file string, block long, odd int, outside long, inside long, first string"), "json-blocks")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    counts = counts.withColumn("start", F.pmod(before("odd"), F.lit(2)).cast("int"))
    first = F.first("first", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = counts.withColumns({"depth": before(F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside"))), "kind": first}).filter("kind is not null")
    starts = starts.select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("start").alias("odd"), "depth", (F.col("kind") == "{").cast("int").alias("base"))
    placed = pieces.withColumn("id", F.monotonically_increasing_id()).join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    placed = placed.sortWithinPartitions("file", "block", "id").select("file", "block", "odd", "depth", "base", "value")
    parts = placed.mapInArrow(_cut_rows, "file string, block long, header boolean, opens long, element long, left boolean, right boolean, text binary")
    parts = staged(parts.withColumn("text", F.col("text").cast("string")), "json-parts")

    opened = parts.groupBy("file", "block").agg(F.max("opens").alias("n")).withColumn("n", before("n"))
    opened = opened.select(F.col("file").alias("f"), F.col("block").alias("b"), "n")
    numbered = parts.join(opened, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    headers = put_together(numbered.filter("header").withColumn("array", F.col("n") + F.col("opens")), "file", "array")
    named = F.regexp_extract("text", r'("(?:[^"\\]|\\.)*")\s*:\s*\[$', 1)
    key = F.when(named != "", F.get(F.from_json(F.concat(F.lit("["), named, F.lit("]")), "array<string>"), F.lit(0))).when(F.trim(F.regexp_replace("text", r"[\s\x{FEFF}]+", "")) == "[", "")
    arrays = headers.select("file", "array", key.alias("key")).filter(F.col("key").isin(keys)).groupBy("file", "key").agg(F.max("array").alias("array"))

    items = numbered.filter("not header").withColumn("array", F.col("n") + F.col("opens") - 1)
    items = items.join(arrays, ["file", "array"])
    within = Window.partitionBy("file", "array").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    passed = items.groupBy("file", "array", "block").agg(F.max("element").alias("e")).withColumn("passed", F.coalesce(F.sum("e").over(within), F.lit(0)))
    passed = passed.select(F.col("file").alias("f"), F.col("array").alias("a"), F.col("block").alias("b"), "passed")
    items = items.join(passed, (F.col("file") == F.col("f")) & (F.col("array") == F.col("a")) & (F.col("block") == F.col("b")))
    items = items.select("file", "key", (F.col("passed") + F.col("element")).alias("pos"), "block", "left", "right", "text")
    whole = items.filter("not left and not right").select("file", "key", "pos", "text")
    found = whole.unionByName(put_together(items.filter("left or right"), "file", "key", "pos"))
    return found.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")


def element_text(text: str) -> Column:
    """An element as the readers of whole documents give it: a string without its quotes, all else as JSON."""
    return F.when(F.col(text).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.col(text))
