"""Reads of the stored graph: listings, pages, previews, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.functions.text import col, contains_ci
from shelfgraph.graph import Graph
from shelfgraph.operators.limits import top_rows
from shelfgraph.operators.substrings import SubstringIndex, possible


def listing(graph: Graph, type_: str, limit: int | None = None) -> DataFrame:
    """Nodes of a type in id order, or the first ``limit`` of them."""
    rows = graph.of_type(type_)
    return rows.orderBy("id") if limit is None else top_rows(rows, limit, F.col("id"))


def works_titled(works: DataFrame, term: str | None = None, limit: int | None = None, title: str = "title", substrings: SubstringIndex | None = None) -> DataFrame:
    """Works whose title contains the term; all of them without one."""
    found = possible(works, term, substrings, "work").filter(contains_ci(title, term)) if term else works
    return top_rows(found, limit, F.col("id")) if limit else found


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows after a key, in key order."""
    return top_rows(rows.filter(F.col(key) > F.lit(after)), limit, F.col(key))


def unfinished(rows: DataFrame, columns: list[str], refresh_all: bool = False) -> DataFrame:
    """Rows lacking at least one of the columns; a whole job is one scan of these, without pages."""
    if refresh_all:
        return rows
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull()
    return rows.filter(test)


def preview(rows: DataFrame, limit: int, *order) -> DataFrame:
    return top_rows(rows, limit, *order)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return payloads(files.select(F.col("path").alias("url"), "content"))


def payloads(rows: DataFrame) -> DataFrame:
    """Binary rows ``(url, content)`` as base64 text, size and success."""
    there = F.col("content").isNotNull()
    return rows.select("url", base64_text("content").alias("data"), F.coalesce(F.length("content"), F.lit(0)).alias("size"),
                       there.alias("success"))


def base64_text(c) -> Column:
    """Base64 without line breaks."""
    return F.translate(F.base64(col(c)), "\r\n", "")
