"""Ranked lexical search: the best documents for each item of a query set, by an exact integer score, with norm buckets.

The score of a document for an item is the inner product of an impact vector of the document, (SCALE * tf) div (1000 * tf + 12 * m), and
the item's term weights. In the manner of LEMP:

1. Impact vectors are ordered by length (their Euclidean norm, each coordinate times the root of its term's weight) and cut into
   buckets by norm, the longest first and each about four times as large as the one before.
2. Each bucket is one Spark job over all of its vectors. For an item whose k-th best score so far is t, a block of vectors is passed over
   if |item| * (largest norm in the block) < t: no inner product can be larger (Cauchy-Schwarz).
3. Inside a block the item's heaviest coordinates, found in the block's inverted lists, give a partial product and what is left of each
   vector's norm: partial + |rest of item| * |rest of vector| < t drops the vector.
4. Survivors are scored again in 64-bit integers. Each task keeps its k best for an item and raises t with them; the
   tasks' rows are merged by rank, and the next bucket starts from the merged t.

A bound is raised by a small factor, far above what doubles can be off, before it is compared, so no vector is dropped by rounding.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms; what is sent to all tasks (vocabulary, item vectors, thresholds) is bounded by
that. A vector holds a document's counts of the block's terms only. N, L and the document frequencies count all documents.

Defined results: null text has no terms. Rows of ``docs`` with the same id are separate documents; a null id comes after all others
at equal scores. Items without terms, or whose terms no document has, have no rows; a repeated item id is an item for each of its rows.
Empty tables give an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.text import LOWER, RangeKeys, chunks, words
from shelfgraph.session import staged

SCALE = 1_000_000_000
BLOCK_TERMS = 500_000
BUCKETS = (1 / 64, 1 / 16, 1 / 4)  # shares of the vectors, longest first, at which buckets end
ROWS = 4_096                       # vectors of a block
FOCUS = 0.7                        # share of an item's squared norm in the coordinates looked at first
SAFE = 1 + 1e-9
NO_ID = np.iinfo(np.int64).max
OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False


def _terms(column: pa.Array):
    """Keys of the terms of each piece of a text column, the row of each, and how many terms each row has."""
    for chunk in chunks(column):
        low = chunk._replace(data=LOWER[chunk.data])
        found = words(low, OUTSIDE)
        yield chunk, RangeKeys(low.data)(found.start, found.end), found.row, np.diff(found.first)


class Items(NamedTuple):
    """A block of items: their terms as numbers of a sorted vocabulary, and how often each occurs."""

    ids: list
    vocabulary: np.ndarray  # term keys
    first: np.ndarray       # the terms of item i are first[i] .. first[i + 1] - 1
    slot: np.ndarray
    times: np.ndarray


def item_block(rows: list[tuple]) -> Items:
    """(id, text) rows as a block; items without terms are left out."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, found, _, size in _terms(pa.array([r[1] for r in rows], pa.string())):
        keys.append(found)
        counts.append(size)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    vocabulary, slot = np.unique(keys, return_inverse=True)
    own = np.repeat(np.arange(len(rows)), counts) * max(1, len(vocabulary)) + slot
    own, times = np.unique(own, return_counts=True)
    item, slot = own // max(1, len(vocabulary)), own % max(1, len(vocabulary))
    some = np.flatnonzero(counts)
    first = np.append(np.searchsorted(item, some), len(item))
    return Items([rows[i][0] for i in some.tolist()], vocabulary, first, slot, times)


def _vector_rows(vocabulary: np.ndarray):
    """(id, n, slots, tf) of the documents with terms: all terms counted, those of the vocabulary kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, row, n in _terms(batch.column(1)):
                place = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
                known = vocabulary[place] == keys
                cell, tf = np.unique(row[known] * len(vocabulary) + place[known], return_counts=True)
                cut = np.searchsorted(cell // len(vocabulary), np.arange(chunk.n + 1))
                some = np.flatnonzero(n)
                slots, tfs = (cell % len(vocabulary)).astype(np.int32), tf.astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(cut[some], cut[-1]).astype(np.int32)), pa.array(values))
                yield pa.record_batch([batch.column(0).slice(chunk.first, chunk.n).take(pa.array(some)), pa.array(n[some]), lists(slots), lists(tfs)], ["id", "n", "slots", "tf"])

    return run


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _impact_rows(weight: np.ndarray, docs: int, terms: int):
    """(id, norm, slots, impact), sorted by norm inside each batch, longest first; vectors without coordinates are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(2)), 0))
            if not batch.num_rows:
                continue
            n, back = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            m = np.array([75 + 25 * x * docs // terms for x in n.tolist()], np.int64)[back]
            slots, tf = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            size = pa.compute.list_value_length(slots).to_numpy()
            cut = np.concatenate([[0], np.cumsum(size)])
            impact = SCALE * tf // (1000 * tf + 12 * np.repeat(m, size))
            norm = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2 * weight[slots.flatten().to_numpy()], cut[:-1])) * SAFE
            impacts = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(impact))
            yield pa.record_batch([batch.column(0), pa.array(norm), slots, impacts], ["id", "norm", "slots", "impact"]).take(pa.array(np.argsort(-norm, kind="stable")))

    return run


class Block:
    """Vectors with their inverted lists."""

    def __init__(self, ids: np.ndarray, norm: np.ndarray, size: np.ndarray, slots: np.ndarray, impact: np.ndarray, root: np.ndarray):
        self.ids, self.norm, self.slots, self.impact = ids, norm, slots, impact
        self.cut = np.concatenate([[0], np.cumsum(size)])
        self.largest = float(norm.max())
        by_slot = np.argsort(slots, kind="stable")
        self.owner = np.repeat(np.arange(len(ids)), size)[by_slot]
        self.value = impact[by_slot] * root[slots[by_slot]]
        self.begin = np.searchsorted(slots[by_slot], np.arange(len(root) + 1))

    def bounds(self, slots: np.ndarray, times: np.ndarray, root: np.ndarray, rest: float) -> np.ndarray:
        """For each vector what the inner product can be at most, from the coordinates ``slots`` of an item and the norm of the rest."""
        partial, used = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for s, x in zip(slots.tolist(), (times * root[slots]).tolist()):
            a, b = self.begin[s], self.begin[s + 1]
            value = self.value[a:b]
            partial[self.owner[a:b]] += x * value
            used[self.owner[a:b]] += value * value
        left = np.maximum(0, self.norm ** 2 - used) + 1e-9 * self.norm ** 2
        return (partial + rest * np.sqrt(left)) * SAFE

    def scores(self, rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Exact inner products of some vectors with an item's integer weights by slot."""
        size = self.cut[rows + 1] - self.cut[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.cut[rows] - ends + size, size) + np.arange(ends[-1])
        sums = np.concatenate([[0], np.cumsum(factor[self.slots[at]] * self.impact[at])])
        return sums[ends] - sums[ends - size]


def _search_rows(items: Items, weight: np.ndarray, start: np.ndarray, k: int):
    """(item, id, score) of each task's best; ``start`` holds the items' k-th best scores so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.sqrt(weight.astype(np.float64))
        most = start.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.ids]
        plans = []
        for i in range(len(items.ids)):
            slot, times = items.slot[items.first[i]:items.first[i + 1]], items.times[items.first[i]:items.first[i + 1]]
            square = times.astype(np.float64) ** 2 * weight[slot]
            heavy = np.argsort(-square, kind="stable")
            focus = heavy[: int(np.searchsorted(np.cumsum(square[heavy]), FOCUS * square.sum())) + 1]
            rest = math.sqrt(max(0.0, square.sum() - square[focus].sum()) + 1e-12 * square.sum())
            plans.append((slot, times, math.sqrt(square.sum()) * SAFE, slot[focus], times[focus], rest))
        factor = np.zeros(len(items.vocabulary), np.int64)

        def search(block: Block) -> None:
            for i, (slot, times, norm, focus, focus_times, rest) in enumerate(plans):
                least = max(1, int(most[i]))
                if norm * block.largest * SAFE < least:
                    continue
                rows = np.flatnonzero(block.bounds(focus, focus_times, root, rest) >= least)
                if not len(rows):
                    continue
                factor[slot] = times * weight[slot]
                score = block.scores(rows, factor)
                factor[slot] = 0
                rows, score = rows[score >= least], score[score >= least]
                ids, score = np.concatenate([best[i][0], block.ids[rows]]), np.concatenate([best[i][1], score])
                order = np.lexsort((ids, -score))[:k]
                best[i] = ids[order], score[order]
                if len(order) == k:
                    most[i] = max(most[i], best[i][1][-1])

        for batch in batches:
            ids = pa.compute.fill_null(batch.column(0), NO_ID).to_numpy()
            size = pa.compute.list_value_length(batch.column(2)).to_numpy()
            cut = np.concatenate([[0], np.cumsum(size)])
            slots, impact, norm = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(ids), ROWS):
                b = min(len(ids), a + ROWS)
                search(Block(ids[a:b], norm[a:b], size[a:b], slots[cut[a]:cut[b]], impact[cut[a]:cut[b]], root))
        for i, (ids, score) in enumerate(best):
            good = score >= most[i]
            if good.any():
                own = ids[good]
                yield pa.record_batch([pa.array(np.full(len(own), i, np.int32)), pa.array(own, mask=own == NO_ID), pa.array(score[good])], ["item", "id", "score"])

    return run


def search_block(rows: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, id, score, rank) for one block of items; ``item`` is its number in the block, ``rows(id, text)`` are the documents."""
    vectors = staged(rows.mapInArrow(_vector_rows(items.vocabulary), "id long, n long, slots array<int>, tf array<int>"), "vectors")
    docs, terms = vectors.agg(F.count("*"), F.sum("n")).first()
    found = vectors.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).collect()  # at most the block's terms
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in found:
        df[r.slot] = r.df
    weight = weights(df, docs)
    impacts = staged(vectors.mapInArrow(_impact_rows(weight, docs, terms or 1), "id long, norm double, slots array<int>, impact array<long>"), "impacts")
    cuts = impacts.agg(F.percentile_approx("norm", F.array(*[F.lit(1 - b) for b in BUCKETS]), F.lit(10_000))).first()[0] or []
    ends = [math.inf, *cuts, -math.inf]
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best, start = None, np.zeros(len(items.ids), np.int64)
    for high, low in zip(ends, ends[1:]):
        bucket = impacts.filter((F.col("norm") < F.lit(high)) & (F.col("norm") >= F.lit(low))) if high < math.inf else impacts.filter(F.col("norm") >= F.lit(low))
        found = bucket.mapInArrow(_search_rows(items, weight, start, k), "item int, id long, score long")
        found = found if best is None else found.unionByName(best.select("item", "id", "score"))
        best = staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        for r in best.filter(F.col("rank") == k).collect():  # at most one row an item
            start[r.item] = r.score
    return best


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, id, score) of the k best documents of each item, score above 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id_col), F.col(item_text_col).cast("string").alias("text"))
    kind = items.schema[item_id_col].dataType.simpleString()
    parts = []

    def add(block: list[tuple]) -> None:
        if block and (found := item_block(block)).ids:
            best = search_block(rows, found, k)
            numbers = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(found.ids)], f"number int, item_id {kind}")
            parts.append(best.join(numbers, F.col("item") == F.col("number")).select("item_id", "rank", "id", "score"))

    block, size = [], 0
    for r in asked.toLocalIterator():  # a block of items at a time
        more = len(r.text or "") // 2
        if block and size + more > block_terms:
            add(block)
            block, size = [], 0
        block.append((r[0], r.text))
        size += more
    add(block)
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, id long, score long")
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
