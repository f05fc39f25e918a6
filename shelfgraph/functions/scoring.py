"""Scores of a work against a reference work: audience, themes, publication period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgraph.functions.text import col


def _year_of(side: Column) -> Column:
    return F.trim(F.get(F.split(side, ","), F.lit(1))).try_cast("int")


def start_year(c) -> Column:
    """Start year of ``MMM DD, YYYY to MMM DD, YYYY``; null when the text has no such part."""
    return _year_of(F.get(F.split(col(c), " to "), F.lit(0)))


def end_year(c, as_of_year) -> Column:
    """End year; an absent or open end counts as ``as_of_year``."""
    today = F.lit(as_of_year).cast("int")
    tail = F.get(F.split(col(c), " to "), F.lit(1))
    dated = tail.contains(",") & ~col(c).contains("?")
    return F.when(dated, _year_of(tail)).otherwise(today)


def overlap_years(start_a, end_a, start_b, end_b) -> Column:
    """Years two inclusive periods share, never below 0; null when a bound is null."""
    bounds = [col(x) for x in (start_a, end_a, start_b, end_b)]
    known = bounds[0].isNotNull() & bounds[1].isNotNull() & bounds[2].isNotNull() & bounds[3].isNotNull()
    shared = F.least(bounds[1], bounds[3]) - F.greatest(bounds[0], bounds[2]) + 1
    return F.when(known, F.greatest(shared, F.lit(0)))


def period_gap(start_a, end_a, start_b, end_b) -> Column:
    """Years from the end of the earlier period to the start of the later one, 0 when they overlap."""
    return F.greatest(
        col(start_b) - col(end_a), col(start_a) - col(end_b), F.lit(0)
    )


def period_jaccard(start_a, end_a, start_b, end_b) -> Column:
    """Shared years over covered years; an unknown start or disjoint periods give 0.0, an unknown end null."""
    a0, a1, b0, b1 = (col(x) for x in (start_a, end_a, start_b, end_b))
    shared = overlap_years(a0, a1, b0, b1)
    covered = (a1 - a0 + 1) + (b1 - b0 + 1) - shared
    return (
        F.when(a0.isNull() | b0.isNull(), F.lit(0.0))
        .when(shared == 0, F.lit(0.0))
        .otherwise(F.try_divide(shared.cast("double"), covered.cast("double")))
    )


def _list(c) -> Column:
    return F.coalesce(col(c), F.array().cast("array<string>"))


def demographic_score(ref, other) -> Column:
    """2 for the same list, 1 for a shared entry, else 0."""
    a, b = _list(ref), _list(other)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(a == b, 2).when(F.arrays_overlap(a, b), 1).otherwise(0)
    )


def themes_overlap(ref, other) -> Column:
    """Entries of the reference list found in the other list, repeats counted."""
    other_list = _list(other)
    return F.size(F.filter(_list(ref), lambda t: F.array_contains(other_list, t)))


def themes_ratio(ref, other) -> Column:
    return F.coalesce(F.try_divide(themes_overlap(ref, other).cast("double"), F.size(_list(ref)).cast("double")), F.lit(0.0))
