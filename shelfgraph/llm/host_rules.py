"""Quality rules of documents, and rules of hosts drawn from how often a host's documents fail them.

The counts of a document are taken in numpy over a piece of an Arrow batch at a time. Hosts' failure rates are shrunk
by a beta prior whose mean and strength come from all hosts (method of moments), so a host with three documents is not
judged by them alone. Only one small row per host is shuffled; verdicts are joined back on the host.

Defined results: null text has no words and fails. A null host is no host: it enters no statistic and its documents
keep their own verdict. Rows that repeat are counted as often as they come. An empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.text import RangeKeys, chunks, lines, mix, window_keys, words
from shelfgraph.session import staged

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's range."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _not_first(row: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each row, how many of its keys equal an earlier key of the row."""
    tagged = mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(tagged, return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def document_counts(chunk) -> list[np.ndarray]:
    """The counts named in COUNTS, for each row of a chunk."""
    data, offsets, n = chunk.data, chunk.offsets, chunk.n
    found, keys = words(chunk), RangeKeys(chunk.data)
    if not len(found.start):
        return [np.zeros(n, np.int64), np.zeros(n, np.int64), _per_row(SYMBOLS[data], offsets), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = np.bincount(found.row, weights=points[found.end] - points[found.start], minlength=n).astype(np.int64)

    windows, at, row = window_keys(keys(found.start, found.end), found.first, 3)
    tagged = mix(windows ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, back, often = np.unique(tagged, return_inverse=True, return_counts=True)
    again = at[often[back] > 1]
    covered = np.zeros(len(found.start), bool)
    for k in range(3):
        covered[again + k] = True

    start, end = lines(chunk)
    end = end - (data[end - 1] == 10)
    worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end = start[worded], end[worded]
    line_row = np.searchsorted(offsets, start, "right") - 1
    return [np.diff(found.first), chars, _per_row(SYMBOLS[data], offsets), _not_first(line_row, keys(start, end), n),
            np.bincount(found.row[covered], minlength=n)]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [document_counts(c) for c in chunks(batch.column(2))]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c.astype(np.int64)) for c in columns)], ["id", "host", *COUNTS])


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source",
               min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """(id, host, counts, base_failed) of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_count_rows, f"id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_rejected): each host's failure rate under the prior that all hosts give.

    The prior Beta(a, b) has the mean m of the hosts' rates and the strength a + b = m (1 - m) / v - 1 of their variance v,
    at least 1; with hosts that are all alike (v = 0) it is as strong as the mean number of documents a host.
    """
    hosts = rows.filter("host is not null").groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    m, v, size, n = hosts.agg(F.avg(raw), F.var_pop(raw), F.avg("n_docs"), F.count("*")).first()
    if not n:
        m = v = size = 0.0
    strength = max(1.0, m * (1 - m) / v - 1) if v else max(1.0, size)
    rate = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Each document's counts, its own verdict, and ``kept``: false if it fails itself or its host is rejected."""
    rows = staged(base_rules(docs, id_col, text_col, host), "rules")
    verdicts = host_verdicts(rows, max_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_rejected")
    joined = rows.join(verdicts, rows.host == verdicts.h, "left").drop("h")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
