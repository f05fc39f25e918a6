"""Matching titles by equality and by containment, without comparing all pairs.

A title contained in another whose length differs by at most ``gap`` is one of the few substrings of
the longer one that drop up to ``gap`` characters at its ends. So containment becomes an equality
join on those substrings: exact, and linear in the number of titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.text import col
from shelfgraph.functions.titles import linkage_title

# Fixed values.
SERIES_GAP = 10
LINK_GAP = 3
LINK_MIN_LENGTH = 5
LINK_MAX_RATIO = 1.8


def near_substrings(c, gap: int) -> Column:
    """Distinct substrings at most ``gap`` characters shorter than the text, none empty."""
    text = col(c)
    by_gap = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(gap), F.greatest(F.length(text) - 1, F.lit(0)))),
        lambda g: F.transform(F.sequence(F.lit(1), g + 1), lambda p: F.substring(text, p, F.length(text) - g)),
    )
    return F.filter(F.array_distinct(F.flatten(by_gap)), lambda s: s != "")


def exact_series(series: DataFrame, works: DataFrame) -> DataFrame:
    """Series whose key is a work key: ``series(series_id, key)``, ``works(work_key, ord)``."""
    keys = works.select(F.col("work_key").alias("key"), "work_key").distinct()
    return series.join(keys, "key").select("series_id", "work_key")


def contained_series(series: DataFrame, works: DataFrame, gap: int = SERIES_GAP) -> DataFrame:
    """For each series, the first work whose key contains the series key, or the other way round.

    Substrings of the work keys are reduced to the first work each before the join, and the join
    returns at most one row per series substring, so a key shared by many titles stays small.
    """
    work = F.struct("ord", "work_key")
    unique = works.groupBy("work_key").agg(F.min("ord").alias("ord"))
    by_substring = (
        unique.select(F.explode(near_substrings("work_key", gap)).alias("key"), work.alias("w"))
        .groupBy("key").agg(F.min("w").alias("w"))
    )
    wider = series.select("series_id", "key").join(by_substring, "key").select("series_id", "w")
    narrower = (
        series.select("series_id", F.explode(near_substrings("key", gap)).alias("work_key"))
        .join(unique, "work_key").select("series_id", work.alias("w"))
    )
    return (
        wider.unionByName(narrower).groupBy("series_id").agg(F.min("w").alias("w")).select("series_id", "w.work_key")
    )


def match_series(series: DataFrame, works: DataFrame, gap: int = SERIES_GAP) -> DataFrame:
    """(series_id, work_key, match): the exact pass, then containment for the rest."""
    exact = exact_series(series, works)
    rest = series.join(exact.select("series_id"), "series_id", "left_anti")
    return exact.withColumn("match", F.lit("exact")).unionByName(
        contained_series(rest, works, gap).withColumn("match", F.lit("contained"))
    )


def exact_links(titles: DataFrame, works: DataFrame) -> DataFrame:
    """(title, id): the first work with exactly this title, or with its reduced form.

    ``titles(title)`` is distinct; ``works(id, title)``.
    """
    first = works.groupBy("title").agg(F.min("id").alias("id"))
    forms = titles.select("title", F.explode(F.array_distinct(F.array("title", linkage_title("title")))).alias("form"))
    found = forms.join(first.withColumnRenamed("title", "form"), "form")
    return found.groupBy("title").agg(F.min("id").alias("id"))


def flexible_links(titles: DataFrame, works: DataFrame) -> DataFrame:
    """(title, id): the nearest work by length among equal-without-spaces and containing titles.

    ``titles(title)`` holds distinct linkage titles (see ``linkage_title``), which have no spaces.
    """
    packed = F.replace(F.lower("title"), F.lit(" "), F.lit(""))
    pieces = (
        works.select("id", F.lower("title").alias("low"), packed.alias("packed"))
        .select("id", "low", "packed", F.explode(near_substrings("packed", LINK_GAP)).alias("form"))
        .withColumn("gap", F.length("packed") - F.length("form"))
        .filter((F.col("gap") == 0) | ((F.length("form") >= LINK_MIN_LENGTH) & F.col("low").contains(F.col("form"))))
    )
    # Nearest work per piece before any join: one row per piece, however many works share it.
    wider = pieces.groupBy("form").agg(F.min(F.struct("gap", "id")).alias("w"))
    wanted = titles.select("title", F.lower("title").alias("form"))
    by_wider = wanted.join(wider, "form").select("title", F.length("form").alias("n"), "w", F.lit(1).alias("sign"))

    whole = (
        works.select(F.lower("title").alias("form"), "id").filter(F.length("form") >= LINK_MIN_LENGTH)
        .groupBy("form").agg(F.min("id").alias("id"))
    )
    shorter = wanted.select("title", F.col("form").alias("full"), F.explode(near_substrings("form", LINK_GAP)).alias("form"))
    by_narrower = shorter.join(whole, "form").select(
        "title", F.length("full").alias("n"),
        F.struct((F.length("full") - F.length("form")).alias("gap"), F.col("id")).alias("w"), F.lit(-1).alias("sign"),
    )
    best = by_wider.unionByName(by_narrower).groupBy("title", "n").agg(F.min(F.struct("w", "sign")).alias("b"))
    other = F.col("n") + F.col("b.sign") * F.col("b.w.gap")
    ratio = F.greatest(F.col("n"), other) / F.nullif(F.least(F.col("n"), other), F.lit(0))
    return best.filter(ratio <= LINK_MAX_RATIO).select("title", F.col("b.w.id").alias("id"))


def link_titles(titles: DataFrame, works: DataFrame) -> DataFrame:
    """(title, id, match) for each distinct title of ``titles`` that finds a work."""
    distinct = titles.select("title").filter(F.coalesce("title", F.lit("")) != "").distinct()
    exact = exact_links(distinct, works)
    rest = distinct.join(exact.select("title"), "title", "left_anti")
    return exact.withColumn("match", F.lit("exact")).unionByName(
        flexible_links(rest, works).withColumn("match", F.lit("flexible"))
    )
