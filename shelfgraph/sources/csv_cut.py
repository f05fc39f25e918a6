"""One large CSV file with line breaks in quoted cells, read by many tasks.

Spark reads a file in blocks of lines. Whether a line begins inside a quoted cell follows from the lines before it: each task works out what its
blocks do to either state, the small rows of a file's blocks are run through in order, and then lines are put together to records;
only records that reach over a block's end meet in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgraph.session import staged
from shelfgraph.sources.json_cut import put_together, runs_of_blocks

#: Up to the end of a quoted cell that is open: quotes are doubled inside.
_REST_OF_CELL = re.compile(rb'(?:[^"]|"")*?"(?!")')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell. A quote opens a cell only where the cell begins."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == b'"':
                inside, at = True, at + 1
            else:
                comma = line.find(b",", at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
        closed = _REST_OF_CELL.match(line, at)
        if closed is None:
            return True
        comma = line.find(b",", closed.end())
        if comma < 0:
            return False
        inside, at = False, comma + 1


def _state_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, outside, inside, lines): the state at a block's end from either state at its start."""
    state: dict[tuple[str, int], list] = {}
    for about, values in runs_of_blocks(batches):
        own = state.setdefault((about["file"], about["block"]), [False, True])
        for line in values:
            if b'"' in line:
                own[0], own[1] = ends_inside(line, own[0]), ends_inside(line, own[1])
    rows = [(f, b, *s) for (f, b), s in state.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "block", "outside", "inside"])


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, number, left, right, text) of a block's records and parts of records."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["file", "block", "number", "left", "right", "text"]
    rows: list[tuple] = []
    about, lines, number, inside, left = None, [], 0, False, False

    def close(right: bool) -> None:
        rows.append((about["file"], about["block"], number, left, right, b"\n".join(lines) + (b"\n" if right else b"")))

    for now, values in runs_of_blocks(batches):
        if about is None or now != about:
            if lines:
                close(True)
            about, lines, number, inside, left = now, [], 0, now["start"], now["start"]
        for line in values:
            lines.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                close(False)
                lines, number, left = [], number + 1, False
        if len(rows) > 5_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
    if lines:
        close(True)
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, start) from a file's blocks in order."""
    file, inside = None, False
    for batch in batches:
        found = []
        for f, b, outside_end, inside_end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            inside = inside if f == file else False
            file = f
            found.append((f, b, inside))
            inside = inside_end if inside else outside_end
        if found:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.bool_()))], ["file", "block", "start"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text) of the records of CSV files, header included, without blank ones."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = staged(lines.mapInArrow(_state_rows, "file string, block long, outside boolean, inside boolean"), "csv-blocks")
    starts = states.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_starts, "file string, block long, start boolean")
    starts = starts.select(F.col("file").alias("f"), F.col("block").alias("b"), "start")
    placed = lines.withColumn("id", F.monotonically_increasing_id()).join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    placed = placed.sortWithinPartitions("file", "block", "id").select("file", "block", "start", "value")
    parts = staged(placed.mapInArrow(_record_rows, "file string, block long, number long, left boolean, right boolean, text binary")
                   .withColumn("text", F.col("text").cast("string")), "csv-parts")
    # A part that goes on in the next block has the number of that block's first one.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("file", "block").agg(F.sum((~F.col("right")).cast("long")).alias("n"))
    passed = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("passed"))
    parts = parts.join(passed, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    parts = parts.select("file", (F.col("passed") + F.col("number")).alias("number"), "block", "left", "right", "text")
    whole = parts.filter("not left and not right").select("file", "number", "text")
    found = whole.unionByName(put_together(parts.filter("left or right"), "file", "number"))
    return found.withColumn("text", F.regexp_replace("text", r"[\r\n]+$", "")).filter(F.trim("text") != "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows with every column as text; the header of the first file names the columns. As ``cells.read_text_csv``, in many tasks a file."""
    rows = staged(records(spark, path), "csv-records")
    first = rows.groupBy("file").agg(F.min("number").alias("n"))
    head = rows.join(first.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("number") == F.col("n"))).orderBy("file").select("text").first()
    if head is None:
        return spark.createDataFrame([], "value string")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    count = head.text.count(",") + 1
    names = spark.createDataFrame([head], "text string").select(F.from_csv("text", ", ".join(f"c{i} string" for i in range(count)), options).alias("v")).select("v.*").first()
    names = [n for n in names if n is not None]
    schema = ", ".join(f"`{n}` string" for n in names)
    body = rows.join(first.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("number") == F.col("n")), "left_anti")
    return body.select(F.from_csv("text", schema, options).alias("v")).select("v.*")
