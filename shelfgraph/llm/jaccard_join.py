"""Jaccard similarity join of documents on word n-grams: exact groups of linked documents and their numbers of links.

1. Each text becomes its set of shingle keys (distinct windows of k words, 64-bit). Equal sets are one class from here on.
2. Classes that can be linked are brought together by their prefixes: a set of n keys has at least t n of them in common with a set of
   similarity t, so if all keys are put in one order, the first n - ceil(t n) + l keys of two similar sets share l. The order is by frequency,
   rarest first, so prefixes are made of keys that nobody else has, unless a set is close to others: passages that many texts
   share come last. Frequencies are exact, and only those of the keys in the lowest part of the key space are needed, as a prefix
   ends there; sets with too little in that part, small ones mostly, go on with their other keys, by frequency among such sets.
   Components of "may be similar, as far as prefixes and sizes tell" are blocks: no link leaves one. In a large corpus rare keys too meet
   by chance, so one shared key alone would bring most texts into one block.
3. Inside a block, a T-occurrence search joins the sets: the inverted lists of a set's keys are split by length, the short ones
   are merged and counted, and sets that may still reach the required overlap are probed in the long ones (DivideSkip). Every pair in a
   block that reaches the overlap is counted; only the edges of a spanning forest leave a task.
4. Links join classes to components.

A block with more than ``BLOCK_KEYS`` keys is cut into chunks, and each pair of chunks is a task of its own: memory stays bounded and no
pair is left out. Nothing is capped.

Defined results: null text and text without words have no shingles and are linked with nothing. Rows equal in text are linked. Repeated
ids are separate rows. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.components import components
from shelfgraph.llm.text import LOWER, Chunk, RangeKeys, chunks, mix, window_keys, words
from shelfgraph.session import staged

BLOCK_KEYS = 4_000_000
SEEN = 1_000_000
NODE_BITS = 1 << 26
SPACE_PERCENT = 160
SHARED, SHARED_STEP = 4, 24  # keys that prefixes must share at most; one more for each so many keys of a set
LISTED = 64  # sets of a key whose pairs are counted
PIECE_BYTES = 4096  # of bitmap_construct_agg
_U = np.uint64


def shingle_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle keys of each row, and where each row's begin and end. Fewer than k words are one shingle."""
    low = chunk._replace(data=LOWER[chunk.data])
    found = words(low)
    keys = RangeKeys(low.data)(found.start, found.end)
    count = np.diff(found.first)
    parts, rows = [], []
    for size in range(1, k + 1):
        if size == k:
            shingles, _, row = window_keys(keys, found.first, k)
        else:
            short = np.flatnonzero(count == size)
            at = (found.first[short][:, None] + np.arange(size)).ravel()
            shingles, _, row = window_keys(keys[at], np.arange(len(short) + 1) * size, size)
            row = short[row]
        parts.append(shingles)
        rows.append(row)
    shingles, row = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    shingles, row = shingles[order], row[order]
    first = np.searchsorted(row, np.arange(chunk.n + 1))
    for a, b in zip(first.tolist(), first.tolist()[1:]):
        shingles[a:b].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(new)])[first]


def set_names(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit name of each row's set."""
    sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(sets ^ _U(salt)), dtype=_U)]) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
    both = np.stack([mix(s[first[1:]] - s[first[:-1]] + np.diff(first).astype(_U)) for s in sums], axis=1)
    return [r.tobytes() for r in both]


def needed(n):
    """How many keys the prefix of a set of n shares with that of a similar set, if not fewer are needed for that one."""
    return np.minimum(SHARED, 1 + n // SHARED_STEP)


def prefix_length(n, percent: int):
    """How many keys of a set of n, first in order, hold ``needed(n)`` of those shared with a similar set: n - ceil(t n) + needed."""
    return n + (-percent * n) // 100 + needed(n)


def space(percent: int) -> int:
    """Where the part of the key space ends whose frequencies are counted: SPACE_PERCENT of what a prefix needs."""
    return min((1 << 64) - 1, (100 - percent) * (1 << 64) * SPACE_PERCENT // 10_000)


def _nodes(names: list[bytes]) -> np.ndarray:
    """64 bits of the names: enough to bring sets together, and a clash only brings more together."""
    return np.frombuffer(b"".join(n[:8] for n in names), "<i8").astype(np.int64)


def _set_rows(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = _U(space(percent))
        for batch in batches:
            names, sizes, low = [], [], []
            for chunk in chunks(batch.column(2)):
                sets, first = shingle_sets(chunk, k)
                names += set_names(sets, first)
                sizes.append(np.diff(first))
                below = np.concatenate([[0], np.cumsum(sets < end)])
                low.append(below[first[1:]] - below[first[:-1]])
            both = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in (sizes, low)]
            yield pa.record_batch([batch.column(0), batch.column(1), *both, pa.array(_nodes(names)), pa.array(names, pa.binary())],
                                  ["id", "text_key", "n_shingles", "n_low", "node", "name"])

    return run


def _key_rows(k: int, percent: int):
    """(key, node) of the keys that a prefix can hold: those in the counted part of the key space, or all if these are too few. Copies met in a task count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, seen = _U(space(percent)), set()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                sets, first = shingle_sets(chunk, k)
                names, found, rows = set_names(sets, first), [np.zeros(0, _U)], []
                cut = first.tolist()
                for i, name in enumerate(names):
                    if name not in seen and cut[i + 1] > cut[i]:
                        seen.add(name)
                        own = sets[cut[i]:cut[i + 1]]
                        low = int(np.searchsorted(own, end))
                        found.append(own[:low] if low >= prefix_length(len(own), percent) else own)
                        rows.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                nodes = np.repeat(_nodes(names)[rows], [len(f) for f in found[1:]])
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(nodes)], ["key", "node"])

    return run


def prefix_keys(texts: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, node, n) of the keys in the sets' prefixes that some other set has too, with the sets' sizes.

    Keys that one set has come first in its prefix, and only their number matters; the others are ranked by frequency and key. The rows of a key
    meet in one task, each set's once a task that read it; what does not fit there goes to disk.
    """
    rows = texts.mapInArrow(_key_rows(k, percent), "key long, node long")
    of_key = Window.partitionBy("key")
    rows = rows.withColumns({"c": F.count("*").over(of_key), "lo": F.min("node").over(of_key), "hi": F.max("node").over(of_key)})
    shared = rows.filter("lo < hi").select("key", "node", "c").distinct()  # copies of one set in several tasks are still one set
    about = sets.filter("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("n_low").alias("low")).withColumnRenamed("node", "o")
    end = space(percent) - (1 << 64) if space(percent) >= 1 << 63 else space(percent)
    inside = F.when(F.col("key") < 0, F.lit(end < 0) & (F.col("key") < end)).otherwise(F.lit(end < 0) | (F.col("key") < end))  # as unsigned numbers
    shared = shared.join(about, F.col("node") == F.col("o")).withColumn("inside", inside)
    order = Window.partitionBy("node", "inside").orderBy("c", "key")
    known = F.count("*").over(Window.partitionBy("node", "inside"))
    ranked = shared.withColumns({"place": F.row_number().over(order), "known": known})
    length = F.col("n") + F.expr(f"-(({percent} * n + 99) div 100) + least({SHARED}, 1 + n div {SHARED_STEP})")
    own = F.when(F.col("inside"), F.col("low")).otherwise(F.col("n"))  # keys of the set up to here; those that no other set has come first
    return ranked.filter(own - F.col("known") + F.col("place") <= length).select("key", "node", "n")


def _size_class(percent: int) -> Column:
    """Sets of similar size are in the same class or in neighbouring ones; rounding moves no two of them further apart."""
    return F.col("n") if percent == 100 else F.floor(F.ln("n") * ((1 - 1e-9) / math.log(100 / percent)))


def likely_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges whose components hold all sets that can be linked, out of the ``keys(key, node, n)`` of the prefixes.

    Of two sets, that whose prefix ends first in the order of keys can have no more in common with the other than the keys both prefixes
    have and all its keys after its prefix. So the keys that two prefixes have are counted and held against the overlap that is needed. Pairs are listed at
    keys that at most ``LISTED`` sets have. At other keys, the sets of a size class are joined without counting, and with those of the next class.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1").withColumnRenamed("key", "k")
    held = lambda which: keys.join(counts.filter(which), F.col("key") == F.col("k")).select("key", "node", "n")
    few = held(f"sets <= {LISTED}").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("own"))
    larger = lambda x, i: F.struct(x.alias("x"), F.filter("own", lambda y, j: (j > i) & (100 * x["n"] >= percent * y["n"])).alias("ys"))
    listed = few.select(F.explode(F.transform("own", larger)).alias("p")).select("p.x", F.explode("p.ys").alias("y"))
    met = listed.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(
        F.count("*").alias("met"), F.min("x.n").alias("n"), F.max("y.n").alias("m"))
    after = lambda n: f"({percent} * {n} + 99) div 100 - least({SHARED}, 1 + {n} div {SHARED_STEP})"  # keys after the prefix
    overlap = f"({percent} * (n + m) + {99 + percent}) div {100 + percent}"
    counted = met.filter(f"met + greatest({after('n')}, {after('m')}, 0) >= {overlap}").select("a", "b")
    classed = held(f"sets > {LISTED}").withColumn("class", _size_class(percent))
    least = classed.groupBy("key", "class").agg(F.min("node").alias("a"))
    by_class = Window.partitionBy("key").orderBy("class")
    next_class = least.withColumns({"b": F.lead("a").over(by_class), "next": F.lead("class").over(by_class)}).filter("next = class + 1").select("a", "b")
    least = least.select(F.col("key").alias("k"), F.col("class").alias("c"), "a")
    joined = classed.join(least, (F.col("key") == F.col("k")) & (F.col("class") == F.col("c"))).filter("a <> node").select("a", F.col("node").alias("b"))
    return counted.union(joined).union(next_class)


def node_bits(nodes: DataFrame) -> bytes:
    """Which of NODE_BITS hashed places the nodes take: a bitmap of bounded size, put together from the tasks' pieces."""
    place = F.pmod("node", F.lit(NODE_BITS))
    bit = place.bitwiseAND(8 * PIECE_BYTES - 1)
    pieces = nodes.select(F.floor(place / (8 * PIECE_BYTES)).alias("piece"), bit.alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = bytearray(NODE_BITS // 8)
    for row in pieces.collect():  # NODE_BITS / 8 bytes at most
        whole[row.piece * PIECE_BYTES:(row.piece + 1) * PIECE_BYTES] = row.bits
    return bytes(whole)


def _member_rows(k: int, bits: bytes):
    """The sets of the documents whose node is in the bitmap, once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(bits, np.uint8), set()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                sets, first = shingle_sets(chunk, k)
                names, cut = set_names(sets, first), first.tolist()
                place = np.mod(_nodes(names), NODE_BITS)
                likely = np.flatnonzero((table[place >> 3] >> (place & 7)) & 1)
                rows = []
                for i in likely.tolist():
                    if names[i] not in seen:
                        seen.add(names[i])
                        rows.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if rows:
                    yield pa.record_batch([pa.array([names[i] for i in rows], pa.binary()), pa.array([sets[cut[i]:cut[i + 1]].tobytes() for i in rows], pa.binary())], ["set_name", "keys"])

    return run


class Linked(NamedTuple):
    tree: list[tuple[int, int]]   # edges of a spanning forest
    links: np.ndarray             # number of linked documents of each set


def t_occurrence(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, percent: int) -> Linked:
    """All pairs of sets with 100 * |x & y| >= percent * |x | y|; of two sides, only pairs across are looked at.

    Sets go in order of size, each as a query against those after it, so the overlap it needs with any of them is at least
    T = 2 p |x| / (100 + p). Lists far longer than the shortest ones are set aside, T - 1 at most; with L set aside, a set that
    does not turn up T - L times in the rest cannot reach T. The others are probed in the long lists.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, side, copies, sets = size[order], side[order], copies[order], [sets[i] for i in order]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    by_key = np.argsort(flat, kind="stable")
    postings = owner[by_key]
    new = np.ones(len(flat), bool)
    new[1:] = flat[by_key][1:] != flat[by_key][:-1]
    begin = np.append(np.flatnonzero(new), len(flat))
    number = np.empty(len(flat), np.int64)
    number[by_key] = np.cumsum(new) - 1
    pairs = (np.cumsum(new) - 1) * n + postings  # sorted
    cut = np.concatenate([[0], np.cumsum(size)])
    both_sides = side.min() != side.max()

    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, links = [], np.zeros(n, np.int64)
    for q in range(n):
        need = -(-2 * percent * int(size[q]) // (100 + percent))
        top = int(np.searchsorted(size, size[q] * 100 // percent, "right"))
        if top <= q + 1:
            continue
        lists = number[cut[q]:cut[q + 1]]
        length = begin[lists + 1] - begin[lists]
        by_length = np.argsort(length, kind="stable")
        lists, length = lists[by_length], length[by_length]
        base = length[: len(lists) - need + 1].mean()
        apart = min(need - 1, int((length > 64 + 16 * base).sum()))
        short, long_ = lists[: len(lists) - apart], lists[len(lists) - apart:]
        width = length[: len(short)]
        ends = np.cumsum(width)
        merged = postings[np.repeat(begin[short] - ends + width, width) + np.arange(ends[-1])]
        count = np.bincount(merged, minlength=n)
        count[: q + 1] = 0
        count[top:] = 0
        if both_sides:
            count[side == side[q]] = 0
        found = np.flatnonzero(count >= max(1, need - apart))
        overlap = count[found]
        if apart and len(found):
            probes = long_[:, None] * n + found
            at = np.minimum(np.searchsorted(pairs, probes), len(pairs) - 1)
            overlap = overlap + (pairs[at] == probes).sum(0)
        found = found[100 * overlap >= percent * (size[q] + size[found] - overlap)]
        links[q] += copies[found].sum()
        links[found] += copies[q]
        for y in found.tolist():
            a, b = root(q), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                tree.append((int(order[q]), int(order[y])))
    back = np.empty(n, np.int64)
    back[order] = links
    return Linked(tree, back)


def _join_rows(percent: int):
    def solve(rows: list[tuple], same: bool) -> Iterator[tuple]:
        rows = list({r[0]: r for r in rows}.values())
        sets = [np.frombuffer(r[3], _U) for r in rows]
        side = np.zeros(len(rows), np.int64) if same else np.array([r[2] for r in rows])
        if len(rows) < 2 or (not same and side.min() == side.max()):
            return
        found = t_occurrence(sets, np.array([r[1] for r in rows], np.int64), side, percent)
        for a, b in found.tree:
            yield rows[a][0], rows[b][0], 0
        for i in np.flatnonzero(found.links).tolist():
            yield rows[i][0], None, int(found.links[i])

    def emit(out: list[tuple]) -> pa.RecordBatch:
        a, b, links = zip(*out, strict=True)
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task, out = None, []
        for batch in batches:
            for block, one, two, name, copies, own, keys in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if task != (block, one, two):
                    if held:
                        out.extend(solve(held, task[1] == task[2]))
                    task, held = (block, one, two), []
                    if len(out) > 10_000:
                        yield emit(out)
                        out = []
                held.append((name, copies, own, keys))
        if held:
            out.extend(solve(held, task[1] == task[2]))
        if out:
            yield emit(out)

    return run


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(id, text_key, n_shingles, component, n_links) of each document.

    ``component`` names the group of documents that links connect (a binary name of one of its sets; null without shingles),
    ``n_links`` counts the documents linked with this one, and ``text_key`` is a hash of the text that tells rows of equal ids apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_key"), "text")
    sets = staged(rows.mapInArrow(_set_rows(k, percent), "id long, text_key long, n_shingles long, n_low long, node long, name binary"), "shingle-sets")
    keys = staged(prefix_keys(rows.select("text"), sets, k, percent), "prefixes")
    blocks = components(likely_pairs(keys, percent), "blocks").select(F.col("node").alias("member"), F.col("component").alias("block"))

    classes = sets.filter("n_shingles > 0").groupBy("name").agg(F.min("node").alias("node"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"))
    members = staged(classes.join(blocks, F.col("node") == F.col("member")).select("name", "node", "n", "copies", "block"), "members")
    weights = members.groupBy("block").agg(F.ceil(F.sum("n") / block_keys).cast("int").alias("chunks")).withColumnRenamed("block", "b")
    asked = members.join(weights, F.col("block") == F.col("b")).select("name", "block", "copies", "chunks")
    loaded = rows.select("text").mapInArrow(_member_rows(k, node_bits(members)), "set_name binary, keys binary")
    loaded = loaded.join(asked, F.col("set_name") == F.col("name")).select("name", "block", "copies", "chunks", "keys").dropDuplicates(["name"])
    own = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("one"), F.greatest(F.col("own"), j).alias("two")))
    dealt = loaded.withColumn("own", own).withColumn("task", F.explode(tasks)).select("block", "task.one", "task.two", "name", "copies", "own", "keys")
    dealt = dealt.repartition("block", "one", "two").sortWithinPartitions("block", "one", "two")
    links = staged(dealt.mapInArrow(_join_rows(percent), "a binary, b binary, links long"), "links")

    groups = components(links.filter("b is not null").select("a", "b"), "groups")
    counts = links.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = groups.join(counts, F.col("node") == F.col("a")).select(F.col("node").alias("g"), F.col("component").alias("c"), "links")
    copies = classes.filter("copies > 1").select(F.col("name").alias("n2"), (F.col("copies") - 1).alias("more"))
    out = sets.select("id", "text_key", "n_shingles", "name").join(known, F.col("name") == F.col("g"), "left").join(copies, F.col("name") == F.col("n2"), "left")
    some = F.col("n_shingles") > 0
    return out.select("id", "text_key", "n_shingles", F.when(some, F.coalesce("c", "name")).alias("component"),
                      F.when(some, F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))


def component_ids(groups: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id, n_links): components named by their smallest id."""
    groups = staged(groups, "groups")
    least = groups.filter("component is not null").groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "c")
    return groups.join(least, F.col("component") == F.col("c"), "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id, and all without shingles."""
    groups = staged(jaccard_groups(docs, k, percent, id_col, text_col), "groups")
    first = groups.filter("component is not null").groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("m")).select("m.*", F.lit(1).alias("rows"))
    bare = groups.filter("component is null").groupBy("id", "text_key").agg(F.count("*").cast("int").alias("rows"))
    stay = first.union(bare)
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text_key"))
    stay = stay.select(key.alias("_stay"), "rows")
    whole = docs.select(F.struct("*").alias("_row"))
    text_key = F.xxhash64(F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit("")))
    whole = whole.withColumn("_key", F.concat_ws(":", F.coalesce(F.col(f"_row.`{id_col}`").cast("long").cast("string"), F.lit("null")), text_key))
    found = whole.join(stay, F.col("_key") == F.col("_stay"))
    turn = Window.partitionBy("_key").orderBy(F.xxhash64("_row"))  # the join has dealt the rows by this key
    return found.withColumn("_n", F.row_number().over(turn)).filter("_n <= rows").select("_row.*")
