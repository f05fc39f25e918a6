"""Benchmark decontamination by winnowing: which words of a text lie in a window of words that a benchmark item has too.

1. Fingerprints. Every run of ``span`` words holds ``span - k + 1`` k-grams; the smallest of their hashes is the window's fingerprint
   (positions of equal hashes all count). Equal windows have equal fingerprints, so no shared run of ``span`` words is missed, and about
   two of seven k-grams are kept at 10 and 5. An item of fewer than ``span`` words is one window, with itself as fingerprint.
2. Fingerprints of texts and items are joined by hash. Each carries the word hashes around it that a window over it can reach.
3. A hit is extended to both sides while the words agree; it counts if ``span`` words or more agree. A window lies within reach of its
   own fingerprint, so the extended hits together cover exactly the words of all shared windows.

Items with the same fingerprint and surroundings are one class; texts are matched with classes, and the items of a set of classes are
listed once for each different set, so a passage that many texts and many items share does not multiply them. Equal texts are matched
once. Texts never leave their scan: a bitmap of the items' fingerprints (two places each, at most ``MOST_SLOTS``) keeps nearly all
fingerprints of clean texts back, and the join after it is exact. Only DataFrame functions are used.

Words are compared by 64-bit hashes, texts by 128 bits.

Defined results: null and empty texts have no words and no hits; items without words match nothing. Each row of ``docs`` gives one row,
repeated rows and ids too. Items are told apart by id; those without an id count as one, listed as an empty string. Empty tables give
empty results, or clean ones. Only the id and text columns are read, whatever else the tables have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words
MOST_SLOTS = 1 << 22
PIECE_BITS = 32768  # of bitmap_construct_agg


def word_hashes(text) -> Column:
    """64-bit hashes of the words of a text, A-Z lower-cased. Splitting takes time in proportion to the text; extracting all matches does not."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.transform(F.array_remove(F.split(low, PARTS), ""), lambda w: F.xxhash64(w))


def _numbers(count: Column) -> Column:
    """0 .. count - 1; empty if count is 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _gram(hashes: Column, at: Column, size: int, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *[F.get(hashes, at + j) for j in range(size)])


def _around(hashes: Column, at: Column, before: int, size: int) -> Column:
    return F.array(*[F.get(hashes, at + j) for j in range(-before, size + before)])


def _selected(grams: Column, at: Column, width: int) -> Column:
    """Whether the k-gram at a place is the smallest of some window of ``width`` k-grams that holds it."""
    windows = F.sequence(F.greatest(at - (width - 1), F.lit(0)), F.least(at, F.size(grams) - width))
    return F.exists(windows, lambda i: F.array_min(F.slice(grams, i + 1, F.lit(width))) == F.get(grams, at))


def _prints(hashes: Column, grams: Column, span: int, k: int, likely) -> Column:
    """The winnowed fingerprints of texts of ``span`` words or more, as structs (size 0, pos, hash, around); ``likely`` is asked first."""
    width = span - k + 1
    chosen = F.filter(_numbers(F.size(grams)), lambda p: likely(F.get(grams, p)) & _selected(grams, p, width))
    return F.transform(chosen, lambda p: F.struct(F.lit(0).alias("size"), p.alias("pos"), F.get(grams, p).alias("hash"), _around(hashes, p, width - 1, k).alias("around")))


def _short_prints(hashes: Column, size: int, likely) -> Column:
    """All runs of ``size`` words, as fingerprints of items of that length."""
    places = F.filter(_numbers(F.size(hashes) - size + 1), lambda p: likely(_gram(hashes, p, size, size)))
    return F.transform(places, lambda p: F.struct(F.lit(size).alias("size"), p.alias("pos"), _gram(hashes, p, size, size).alias("hash"), _around(hashes, p, 0, size).alias("around")))


def _grams(hashes: Column, span: int, k: int) -> Column:
    return F.transform(_numbers(F.when(F.size(hashes) >= span, F.size(hashes) - k + 1).otherwise(0)), lambda p: _gram(hashes, p, k, 0))


def item_prints(items: DataFrame, span: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, size, hash, around, kind) of the items' fingerprints; ``kind`` names those equal in all but the item."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_hashes(F.col(text_col)).alias("hashes"))
    rows = rows.withColumn("grams", _grams(F.col("hashes"), span, k))
    every = lambda h: F.lit(True)
    short = [F.when(F.size("hashes") == s, _short_prints(F.col("hashes"), s, every)) for s in range(1, span)]
    found = rows.select("item", F.explode(F.coalesce(*short, _prints(F.col("hashes"), F.col("grams"), span, k, every))).alias("f"))
    return found.select("item", "f.size", "f.hash", "f.around").distinct().withColumn("kind", F.xxhash64("size", "hash", "around"))


def _slot(h: Column, turn: int, slots: int) -> Column:
    return F.pmod(F.shiftright(h, 24 * turn), F.lit(slots))


def slot_bytes(prints: DataFrame, slots: int) -> bytes:
    """One byte, '1' if the slot is taken, for each of a bounded number of slots."""
    places = prints.select(F.explode(F.array(_slot(F.col("hash"), 0, slots), _slot(F.col("hash"), 1, slots))).alias("s"))
    pieces = places.groupBy(F.expr(f"s div {PIECE_BITS}").alias("piece")).agg(F.bitmap_construct_agg(F.pmod("s", F.lit(PIECE_BITS))).alias("bits"))
    taken = bytearray(b"0" * slots)
    for row in pieces.collect():  # at most MOST_SLOTS / PIECE_BITS rows
        bits = bin(int.from_bytes(row.bits, "little"))[:1:-1].encode()[:slots]
        taken[row.piece * PIECE_BITS:row.piece * PIECE_BITS + len(bits)] = bits
    return bytes(taken)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document."""
    prints = staged(item_prints(items, span, k, item_id_col, item_text_col), "item-prints")
    known = prints.select("size", "hash", "around", "kind").distinct()
    sizes = {r.size: r.n for r in known.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most span rows
    slots = min(MOST_SLOTS, 1 << max(14, (64 * sum(sizes.values())).bit_length()))
    taken = F.lit(slot_bytes(known, slots))
    # One row at a time: an exploded array of one keeps the hashes from being computed for each use.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", "text", F.explode(F.array(word_hashes(F.col("text")))).alias("hashes"))
    rows = rows.select("id", "text", "hashes", F.explode(F.array(_grams(F.col("hashes"), span, k))).alias("grams"))

    def likely(h: Column) -> Column:
        one = lambda turn: F.substring(taken, _slot(h, turn, slots).cast("int") + 1, F.lit(1)) == F.lit(b"1")
        return one(0) & one(1)

    found = [_prints(F.col("hashes"), F.col("grams"), span, k, likely)] if 0 in sizes else []
    found += [_short_prints(F.col("hashes"), s, likely) for s in sorted(sizes) if s]
    none = F.array().cast("array<struct<size:int,pos:int,hash:bigint,around:array<bigint>>>")
    key = F.md5(F.coalesce("text", F.lit("")))
    rows = rows.select("id", F.size("hashes").cast("long").alias("n_words"), key.alias("key"), F.concat(none, *found).alias("prints"))
    rows = staged(rows.withColumn("key", F.when(F.size("prints") > 0, F.col("key"))), "prints")

    texts = rows.filter(F.size("prints") > 0).select("key", F.explode("prints").alias("f")).select("key", "f.*")
    other = known.select(F.col("size").alias("size2"), F.col("hash").alias("hash2"), F.col("around").alias("around2"), "kind")
    met = texts.join(other, (F.col("size") == F.col("size2")) & (F.col("hash") == F.col("hash2")))
    before, reach = span - k, 2 * span - k
    same = [F.coalesce(F.get("around", F.lit(j)) == F.get("around2", F.lit(j)), F.lit(False)) for j in range(reach)]
    left = before - 1 - F.greatest(F.lit(-1), F.lit(-1), *[F.when(~same[j], F.lit(j)).otherwise(-1) for j in range(before)])
    right = F.least(F.lit(reach), F.lit(reach), *[F.when(~same[j], F.lit(j)).otherwise(reach) for j in range(before + k, reach)]) - before - k
    core = same[before]
    for j in range(before + 1, before + k):
        core = core & same[j]
    met = met.withColumns({"left": F.when(F.col("size") == 0, left).otherwise(0), "length": F.when(F.col("size") == 0, left + k + right).otherwise(F.col("size"))})
    hit = F.when(F.col("size") == 0, core & (F.col("length") >= span)).otherwise(F.col("around") == F.col("around2"))
    hits = staged(met.filter(hit).select("key", (F.col("pos") - F.col("left")).alias("from"), (F.col("pos") - F.col("left") + F.col("length")).alias("to"), "kind").distinct(), "hits")

    spans = hits.select("key", "from", "to").distinct()
    seen = F.max("to").over(Window.partitionBy("key").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest("from", F.coalesce("seen", "from")))
    covered = spans.withColumn("seen", seen).groupBy("key").agg(F.sum(fresh).alias("hit"))
    kinds = hits.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    lists = kinds.select("kinds").distinct().select("kinds", F.explode("kinds").alias("kind")).join(prints.select("kind", "item").distinct(), "kind")
    lists = lists.groupBy("kinds").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = lists.select(F.col("kinds").alias("k2"), F.size("items").cast("long").alias("items"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha"))
    listed = kinds.join(lists, F.col("kinds") == F.col("k2")).select(F.col("key").alias("k3"), "items", "sha")
    by_text = covered.join(listed, F.col("key") == F.col("k3")).select("k3", "hit", "items", "sha")

    zero = F.lit(0).cast("long")
    result = lambda df: df.select("id", "n_words", F.coalesce("hit", zero).alias("n_hit"), F.coalesce("items", zero).alias("n_items"),
                                  F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"))
    clean = rows.filter(F.size("prints") == 0).withColumns({"hit": F.lit(None).cast("long"), "items": F.lit(None).cast("long"), "sha": F.lit(None).cast("string")})
    asked = rows.filter(F.size("prints") > 0).join(by_text, F.col("key") == F.col("k3"), "left")
    return result(asked).unionByName(result(clean))

