"""How the sources of a language differ: divergence of every two sources, and the terms that mark a source.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms found in ``least_docs`` of its
documents or more, V in number. A group (lang, source), and the language itself, gives a kept term the share
p = 1 + floor(SCALE * (count + 1) / (N + V)), N being the group's sum of counts. Divergence of p from q is f = floor((p - q)^2 / q).

The sum of f over all kept terms, for every two sources, is taken without looking at each term for each pair:

* a term that neither source has gives f of their empty shares: V times that is the base;
* a term that one source has corrects the base by an amount that depends on its count there only: each source's counts are
  grouped by value first;
* a term that both have corrects that again. Term rows, their nonzero counts in order of source, are paths of a frequent-pattern tree:
  equal rows are one path with a multiplicity, paths with the same beginning share its nodes, and each combination of a node and one of
  its ancestors adds its correction once, times the node's multiplicity. Paths are sorted and range-partitioned, so a task holds a
  part of the tree, and sees it in pieces of bounded size; corrections add up by pair of sources.

Scale: texts are counted where they are read, and only (lang, source, term) sums are shuffled. A path has at most as many nodes as
its language has sources; the result itself has a row for every two sources of a language. No step gathers more than that.

All arithmetic is exact: shares need counts below 9e17 in a group, and sums of corrections are decimals of 38 digits.

Defined results: null text, lang and source count as ''. Groups without terms, and languages without kept terms (value 0), have their
pair rows. Repeated rows and ids are separate documents. An empty table gives an empty result. Only text, lang and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.text import LOWER, RangeKeys, chunks, words
from shelfgraph.session import staged

SCALE = 1_000_000_000
TREE_CELLS = 400_000  # of the matrix of paths that a task looks at together
PIECE = 1 << 21       # bytes of text counted together
OUTSIDE = np.ones(256, bool)
OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, term, n, docs) of each batch of (g, text): occurrences in the rows of a group, and rows that hold the term."""
    for batch in batches:
        names, group = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        for chunk in chunks(batch.column(1), PIECE):
            low = chunk._replace(data=LOWER[chunk.data])
            found = words(low, OUTSIDE)
            if not len(found.start):
                continue
            _, first, number = np.unique(RangeKeys(low.data)(found.start, found.end), return_index=True, return_inverse=True)
            terms = pa.array([low.data[a:b].tobytes() for a, b in zip(found.start[first].tolist(), found.end[first].tolist())], pa.binary())
            by_doc, n = np.unique(found.row * len(first) + number, return_counts=True)
            own = group[chunk.first + by_doc // len(first)] * len(first) + by_doc % len(first)
            order = np.argsort(own, kind="stable")
            own, n = own[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            keys = own[cut]
            yield pa.record_batch([pa.array(names[keys // len(first)]), terms.take(pa.array(keys % len(first))), pa.array(np.add.reduceat(n, cut)),
                                   pa.array(np.diff(np.append(cut, len(own))))], ["g", "term", "n", "docs"])


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, whole, first) of the kept terms; ``whole`` sums over the language, ``first`` marks one row of each term.

    Groups are named by a 64-bit hash until their counts are summed.
    """
    g = F.xxhash64("lang", "source")
    counts = docs.select(g.alias("g"), "text").mapInArrow(_count_rows, "g long, term binary, n long, docs long")
    counts = counts.groupBy("g", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    names = docs.select(g.alias("g2"), "lang", "source").distinct()
    counts = counts.join(names, F.col("g") == F.col("g2")).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "docs")
    term = Window.partitionBy("lang", "term")
    turn = F.row_number().over(term.orderBy("source"))
    kept = counts.withColumns({"whole": F.sum("n").over(term), "all": F.sum("docs").over(term), "first": (turn == 1).cast("long")})
    return kept.filter(F.col("all") >= least_docs).select("lang", "source", "term", "n", "whole", "first")


def share(count, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly: in decimals where the product has more than 64 bits. Null without kept terms."""
    part = (count + F.lit(1)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.nullif(total + kept, F.lit(0).cast("long"))
    small = F.call_function("div", (count + F.lit(1)) * F.lit(SCALE).cast("long"), whole)
    return F.lit(1).cast("long") + F.when(count < 9 * SCALE, small).otherwise(F.call_function("div", part, whole.cast("decimal(19,0)")))


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tree_corrections(source: np.ndarray, p: np.ndarray, empty: np.ndarray, length: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corrections (g, h, amount) of the pairs of sources that sorted paths share.

    Row i holds a path of ``length[i]`` nodes: source number, share and the source's empty share of each; it stands for ``times[i]`` terms.
    A node is a row's entry at some depth that the row before does not have with the same entries above it.
    """
    deepest, n = source.shape[1], source.shape[0]
    sources = int(source.max()) + 1 if source.size else 0
    codes, amounts = [], []
    shared = np.ones(n, bool)
    shared[:1] = False
    for depth in range(deepest):
        same = np.zeros(n, bool)
        same[1:] = (source[1:, depth] == source[:-1, depth]) & (p[1:, depth] == p[:-1, depth])
        shared = shared & same
        rows = np.flatnonzero(length > depth)
        if not len(rows):
            break
        new = ~shared[rows]
        nodes, many = rows[new], np.zeros(int(new.sum()), np.int64)
        np.add.at(many, np.cumsum(new) - 1, times[rows])
        if depth == 0:
            continue
        g, a, a0 = source[nodes, depth][:, None], p[nodes, depth][:, None], empty[nodes, depth][:, None]
        h, b, b0 = source[nodes, :depth], p[nodes, :depth], empty[nodes, :depth]
        for one, two, x, y, x0, y0 in ((g, h, a, b, a0, b0), (h, g, b, a, b0, a0)):
            amount = many[:, None] * (_f(x, y) - _f(x, y0) - _f(x0, y) + _f(x0, y0))
            code = (one * sources + two).ravel()
            order = np.argsort(code, kind="stable")
            code, amount = code[order], amount.ravel()[order]
            cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            codes.append(code[cut])
            amounts.append(np.add.reduceat(amount, cut))
    if not codes:
        none = np.zeros(0, np.int64)
        return none, none, none
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, back, np.concatenate(amounts))
    return code // sources, code % sources, total


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, h, amount) of the parts of the tree that lie in the batches, a language at a time."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        at = 0
        while at < len(langs):
            end, deepest = at, 0
            length = pa.compute.list_value_length(batch.column(1).slice(at)).to_numpy(zero_copy_only=False)
            while end < len(langs) and langs[end] == langs[at] and max(deepest, length[end - at]) * (end - at + 1) <= max(TREE_CELLS, length[end - at]):
                deepest = max(deepest, int(length[end - at]))
                end += 1
            n, length = end - at, length[:end - at].astype(np.int64)
            flat = batch.column(1).slice(at, n).flatten()
            names = flat.field(0).dictionary_encode()
            place = np.arange(deepest) < length[:, None]
            matrix = []
            for values in (names.indices, flat.field(2), flat.field(3)):
                cells = np.ones((n, deepest), np.int64)
                cells[place] = values.to_numpy(zero_copy_only=False)
                matrix.append(cells)
            g, h, amount = tree_corrections(*matrix, length, batch.column(2).slice(at, n).to_numpy(zero_copy_only=False))
            if len(g):
                yield pa.record_batch([pa.array([langs[at]] * len(g), pa.string()), names.dictionary.take(pa.array(g)), names.dictionary.take(pa.array(h)), pa.array(amount)],
                                      ["lang", "g", "h", "amount"])
            at = end


def audit(docs: DataFrame, least_docs: int = 3, term_ranks: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by divergence, and the terms with the largest excess."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    kept = staged(term_counts(rows, least_docs), "terms")

    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("all"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("own", zero).alias("own"), F.coalesce("v", zero).alias("v"), F.coalesce("all", zero).alias("all"))
    groups = staged(groups.withColumn("p0", share(zero, F.col("own"), F.col("v"))), "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("own"), F.col("v")))

    marks = shares.withColumn("q", share(F.col("whole"), F.col("all"), F.col("v"))).filter("p > q")
    marks = marks.select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = marks.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= term_ranks)

    nodes = F.array_sort(F.collect_list(F.struct("source", "n", "p", "p0")))  # at most the language's sources
    paths = shares.groupBy("lang", "term").agg(nodes.alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times"))
    # Ranges by the first nodes keep what begins alike together; the hash parts very common beginnings. The sample for the ranges is of these short keys.
    ranges = ["lang", F.slice("path", 1, 2), F.xxhash64("path")]
    paths = paths.filter(F.size("path") > 1).repartitionByRange(*ranges).sortWithinPartitions("lang", "path")
    both = paths.mapInArrow(_tree_rows, "lang string, g string, h string, amount long")

    amount = lambda c: c.cast("decimal(38,0)")
    counts = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("r0"))
    single = counts.join(others, "lang").filter("source <> other")
    here = (divergence("p", "r0") - divergence("p0", "r0")) * F.col("times")
    there = (divergence("r0", "p") - divergence("r0", "p0")) * F.col("times")
    single = single.groupBy("lang", "source", "other").agg(F.sum(amount(here)).alias("here"), F.sum(amount(there)).alias("there"))
    base = groups.join(others, "lang").filter("source <> other")
    base = base.select("lang", F.col("source").alias("g"), F.col("other").alias("h"), amount(F.coalesce(divergence("p0", "r0"), zero) * F.col("v")).alias("amount"))
    parts = base.unionByName(single.select("lang", F.col("source").alias("g"), F.col("other").alias("h"), F.col("here").alias("amount")))
    parts = parts.unionByName(single.select("lang", F.col("other").alias("g"), F.col("source").alias("h"), F.col("there").alias("amount")))
    parts = parts.unionByName(both.select("lang", "g", "h", amount(F.col("amount")).alias("amount")))
    sums = parts.groupBy("lang", "g", "h").agg(F.sum("amount").cast("long").alias("value"))
    pairs = sums.select("lang", F.col("g").alias("source"), F.col("h").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))

    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
