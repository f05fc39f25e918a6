"""Mixing sources to target weights by a curriculum that changes over the run; DataFrame functions only.

Each source has a weight schedule: values at equally spaced points of training time 0..1, linear in between. Its integral
W(t) says how much of the source's target is due by t. Its documents, in a fixed random order, make up its cumulative
supply; a document that begins after c of the target words is trained at the time where target * W(t) / W(1) = c
(a quadratic in one piece of the schedule). A range sort by that time is the training order; no task sees a source whole.

Cumulative supply is a sum in two steps: over 4096 hash slices of each source, then inside one slice. A copy's position in the training order
is counted the same way: over 4096 spans of training time (copies due at time 0 by slice instead), then inside one span.

Defined results: null text has size 0. Sources are ordered by code point, null (a source of its own) last. A document of
size 0 is taken when it falls inside the target. Equal rows are separate documents. An empty table gives an empty result.
Only the named columns are read by ``shares`` and ``positions``; ``training_order`` carries all columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Weight over training time, by turns: falling, even, rising.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SHARE = 1.5
MAX_EPOCHS = 2


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null. Splitting takes time in proportion to the text; counting the matches of a pattern extracts them all, which does not."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def shares(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size, target, knots) from (source, size) rows.

    Targets are min(epochs * source_size, level * weight) with the one level that spends the whole share: the largest
    of (share - caps of the sources that fill up first) / (weights of the others). One row per source is sorted for it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(name) - 1).cast("int")

    def cycle(values):
        return F.element_at(F.array(*values), turn % len(values) + 1)

    per = per.select("source", "source_size", cycle([F.lit(float(w)) for w in weights]).alias("w"),
                     cycle([F.array(*(F.lit(float(x)) for x in s)) for s in schedules]).alias("knots"))
    cap = epochs * F.col("source_size")
    order = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = per.withColumn("level", (total - before) / rest)
    return level.withColumn("top", F.max("level").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", F.least(cap.cast("double"), F.col("top") * F.col("w")).alias("target"), "knots")


def due_time(part: Column, knots: Column) -> Column:
    """The time t at which the integral of the schedule reaches ``part`` (0..1) of its whole."""
    steps = F.size(knots) - 1
    areas = F.zip_with(F.slice(knots, F.lit(1), steps), F.slice(knots, F.lit(2), steps), lambda a, b: (a + b) / 2)
    sums = F.transform(F.sequence(F.lit(0), steps), lambda k: F.aggregate(F.slice(areas, F.lit(1), k), F.lit(0.0), lambda s, x: s + x))
    due = part * F.element_at(sums, -1)
    piece = F.greatest(F.lit(1), F.least(steps, F.size(F.filter(sums, lambda s: s <= due))))
    a, b = F.element_at(knots, piece), F.element_at(knots, piece + 1)
    left = F.greatest(F.lit(0.0), due - F.element_at(sums, piece))
    # a x + (b - a) x^2 / 2 = left, in the form that also holds for b = a
    x = F.try_divide(2 * left, a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * left)))
    return (piece - 1 + F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))) / steps


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", carry: bool = False, keyed: bool = False,
              **mix) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, supplied, copies, times [, row] [, slice, nth]).

    ``supplied`` is how many words of the source come before it in one pass, ``copies`` how often it is taken, ``times`` when.
    A copy is taken when more than half of it, or exactly half, lies inside the target. (source, slice, nth) is a key of the rows.
    """
    order = F.md5(F.concat_ws(":", F.col(source).cast("string"), F.col(id_col).cast("string")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"), order.alias("place"),
        *([F.struct("*").alias("row")] if carry else []),
    ).withColumn("slice", F.substring("place", 1, 3))
    narrow = rows.select("source", "slice", "size")
    slices = narrow.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("earlier", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
    target = shares(slices.select("source", F.col("slice_size").alias("size")), **mix)
    target = target.select(F.col("source").alias("s"), "source_size", "target", "knots")
    begin = slices.join(target, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("slice").alias("sl"), "earlier", "source_size", "target", "knots")
    inside = Window.partitionBy("source", "slice").orderBy("place", "id", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"inner": F.coalesce(F.sum("size").over(before), F.lit(0)), "nth": F.row_number().over(inside)}).join(
        begin, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).withColumn("supplied", F.col("earlier") + F.col("inner"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(mix.get("epochs", MAX_EPOCHS) - 1)), lambda k: k * F.col("source_size") + F.col("supplied"))
    taken = F.filter(starts, lambda c: 2 * c + F.col("size") <= 2 * F.col("target"))
    times = F.transform(taken, lambda c: due_time(
        F.when(F.col("target") > 0, F.least(F.lit(1.0), c / F.col("target"))).otherwise(F.lit(0.0)), F.col("knots")))
    return placed.select("id", "source", "size", "source_size", "target", "supplied", F.size(taken).alias("copies"), times.alias("times"),
                         *(["row"] if carry else []), *(["slice", "nth"] if keyed else []))


#: The total order of copies in training.
ORDER = ("time", "slice", "source", "nth", "copy")


def training_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", **mix) -> DataFrame:
    """One row per document: the columns of ``positions`` and ``ranks``, the positions of its copies in the training order, from 1."""
    number = F.conv("slice", 16, 10).cast("int")
    copies = positions(docs, id_col, text_col, source, keyed=True, **mix).select("*", F.posexplode_outer("times").alias("copy", "time")).withColumn(
        "span", F.when(F.col("time").isNull(), -1 - number).when(F.col("time") == 0, number).otherwise((4096 + F.floor(F.col("time") * 4096)).cast("int")))
    spans = copies.filter("span >= 0").groupBy("span").agg(F.count("*").alias("n"))
    spans = spans.select(F.col("span").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = copies.withColumn("rank", F.row_number().over(Window.partitionBy("span").orderBy(*ORDER))).join(spans, F.col("span") == F.col("s"), "left")
    place = F.when(F.col("time").isNotNull(), F.struct("copy", (F.col("earlier") + F.col("rank")).alias("rank")))
    kept = ("id", "size", "source_size", "target", "supplied", "copies", "times")
    return ranked.groupBy("source", "slice", "nth").agg(*(F.first(c).alias(c) for c in kept), F.sort_array(F.collect_list(place)).alias("places")).select(
        "id", "source", *kept[1:], F.col("places.rank").alias("ranks"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", **mix) -> DataFrame:
    """The mix itself: rows of ``docs``, one for each copy taken, range-sorted by training time."""
    taken = positions(docs, id_col, text_col, source, carry=True, keyed=True, **mix)
    return taken.select("row", "slice", "source", "nth", F.posexplode("times").alias("copy", "time")).orderBy(*ORDER).select("row.*")
