"""A quality classifier: histogram gradient-boosted trees over statistics of documents.

The statistics are taken in numpy over pieces of Arrow batches. Training sees a bounded sample of labelled rows
(``SAMPLE_ROWS``, by hash of the id), so its cost does not grow with the corpus. The trees are complete binary trees kept in three
arrays (feature, threshold, leaf value); a batch walks all trees at once, one array step a level.

Defined results: null text is empty text, and gets a score too. Labels that are null are not learned from. With no
labels, or labels of one kind, every score is that kind's share (0.5 without labels). Equal texts get equal scores. An empty
table gives an empty result. Only the named columns are read, and only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.host_rules import document_counts
from shelfgraph.llm.text import chunks, lines, words

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 80, 4, 64, 0.15, 1.0, 3.0

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"!", b"?", b".", b",", b":;", b"\"'`",
           b"()-", b"{}[]=+_~^\\/@"]
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(_GROUPS, 1):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = len(_GROUPS) + 1
_CLASS[0xC0:] = len(_GROUPS) + 2
_N = len(_GROUPS) + 3
_UPPER, _SYMBOL = 1, [k for k, chars in enumerate(_GROUPS, 1) if chars in (b"#", b"*", b"$", b"%", b"&", b"|", b"<>")]
_BANG, _BAR, _STOP = (1 + _GROUPS.index(c) for c in (b"!", b"|", b"."))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(chunk) -> np.ndarray:
    """A row of numbers for each text of a chunk."""
    data, offsets, n = chunk.data, chunk.offsets, chunk.n
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = _CLASS[data]
    hist = np.bincount(row * _N + kinds, minlength=n * _N).reshape(n, _N)
    counted = document_counts(chunk)
    n_words, word_chars, n_symbols, dup_lines, repeated = counted
    found = words(chunk)
    length = found.end - found.start
    first = np.bincount(found.row, weights=kinds[found.start] == _UPPER, minlength=n)
    last = kinds[found.end - 1]
    ends = [np.bincount(found.row, weights=np.isin(last, kind), minlength=n) for kind in (_SYMBOL, [_BANG], [_STOP])]
    longest = np.zeros(n)
    np.maximum.at(longest, found.row, length)
    spread = np.bincount(found.row, weights=length.astype(float) ** 2, minlength=n)

    starts, _ = lines(chunk)
    line = np.zeros(len(data), np.int64)
    line[starts] = 1
    line = np.cumsum(line) - 1
    parts_of = np.bincount(line * _N + kinds, minlength=len(starts) * _N).reshape(len(starts), _N) if len(starts) else np.zeros((0, _N))
    total = parts_of.sum(1)
    owner = np.searchsorted(offsets, starts, "right") - 1
    full = total > 1
    letters = np.maximum(total - parts_of[:, 3], 1)
    marks = [parts_of[:, _SYMBOL].sum(1) / letters, parts_of[:, _UPPER] / letters, parts_of[:, _BANG] / letters, parts_of[:, _BAR] / letters]
    worst, parts = [], []
    for mark, most in zip(marks, (0.04, 0.4, 0.04, 0.02), strict=True):
        top = np.zeros(n)
        np.maximum.at(top, owner, np.where(full, mark, 0))
        worst.append(top)
        parts.append(_share(np.bincount(owner, weights=(mark > most) * total, minlength=n), size))
    n_lines = np.bincount(owner, weights=full, minlength=n)
    long_line = np.zeros(n)
    np.maximum.at(long_line, owner, total)
    columns = [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), _share(word_chars, n_words), longest, _share(spread, n_words), _share(n_symbols, size),
               _share(dup_lines, n_lines), _share(repeated, n_words), _share(first, n_words), *(_share(e, n_words) for e in ends), _share(size, n_lines),
               np.log1p(long_line), *worst, *parts, *(_share(hist[:, k], size) for k in range(_N))]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


class Trees(NamedTuple):
    """Complete trees of one depth: node k has the children 2 k + 1 and 2 k + 2; a row goes right if its value is above."""

    start: float
    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray       # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.leaf.size:
            return np.full(len(x), _sigmoid(self.start))
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        base, rows = np.arange(trees) * inner, np.arange(len(x))[:, None]
        while node.size and node[0, 0] < inner:
            at = base + node
            node = 2 * node + 1 + (x[rows, self.feature.ravel()[at]] > self.threshold.ravel()[at])
        return _sigmoid(self.start + self.leaf.ravel()[np.arange(trees) * self.leaf.shape[1] + node - inner].sum(1))


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosted trees for 0/1 labels with logistic loss, from histograms of gradients over quantile bins."""
    inner = 2 ** depth - 1
    none = np.zeros((0, 0))
    if not len(y):
        return Trees(0.0, none, none, none)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Trees(start, none, none, none)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: above cut b - 1, up to cut b
    flat = binned + np.arange(width) * bins
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32)
    leaf = np.zeros((trees, inner + 1))
    z = np.full(n, start)
    for t in range(trees):
        p = _sigmoid(z)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            hist = [np.bincount(at, weights=np.repeat(w, width), minlength=count * width * bins).reshape(count, width, bins) for w in (g, h)]
            left_g, left_h = (a.cumsum(2) for a in hist)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
            gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        sums = [np.bincount(node - inner, weights=w, minlength=inner + 1) for w in (g, h)]
        leaf[t] = -RATE * sums[0] / (sums[1] + RIDGE)
        z += leaf[t][node - inner]
    return Trees(start, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold, chosen by a hash of their ids."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), F.col("i") == F.col("id")).select("id", "y", "text")  # at most sample_rows pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                x = statistics(chunk)
                part = batch.slice(chunk.first, chunk.n)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id long, y int, x binary").limit(2 * sample_rows).collect()
    got.sort(key=lambda r: (r.id, r.y, r.x))
    if not got:
        return fit(np.zeros((0, 0)), np.zeros(0))
    return fit(np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), -1), np.array([r.y for r in got], float))


def score_function(model: Trees):
    """A column function that scores texts in their place, so that the other columns of a row stay as they are."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.scores(statistics(c)) for c in chunks(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(statistics(c)) for c in chunks(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents at or above the threshold, with their own columns."""
    whole = docs.select(F.struct("*").alias("row"))
    return whole.filter(score_function(model)(F.col(f"row.`{text_col}`").cast("string")) >= threshold).select("row.*")
