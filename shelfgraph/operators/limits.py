"""Row-bounded results and first-row-per-key selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfgraph.session import spread

DEALS = 8  # shares of the rows of one key that a look-up joins apart


def top_rows(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows of a total order (one TakeOrdered step, no full sort)."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.orderBy(*order).limit(limit)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Written as ``row_number() = 1``: Spark turns it into a group limit that drops the other rows
    before the shuffle, so a key with very many rows sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key, with the same pre-shuffle group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def look_up(rows: DataFrame, key: str, other: str, values: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values(<key>, ...)``, null where there are none: a left join for keys of which some have very many rows.

    The rows of a key are dealt by a digest of the column ``other`` over ``DEALS`` shares that meet a copy of the value each. Narrow rows pack well, so
    their bytes in a shuffle say little of the memory they take: they decide neither the number of tasks nor, by the hint, a broadcast.
    """
    dealt = spread(rows.withColumn("_deal", F.pmod(F.xxhash64(other), F.lit(DEALS)).cast("int")), key, "_deal")
    copies = values.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return dealt.join(copies.hint("merge"), [key, "_deal"], "left").drop("_deal")
