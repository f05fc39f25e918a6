"""Filters over nodes, edges and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.nodes import mentions
from shelfgraph.functions.text import contains_ci
from shelfgraph.graph import Graph, empty_like

JAPANESE = "japanese"
ENGLISH = "english"


def title_matches(term: str | None, language: str = ENGLISH) -> Column:
    """Substring test over the title columns of a language; no term matches everything."""
    if term is None:
        return F.lit(True)
    if language == JAPANESE:
        return contains_ci("japanese_name", term) | contains_ci("title_name", term) | contains_ci("title", term)
    return contains_ci(F.coalesce("title_name", "title"), term) | contains_ci("english_name", term)


def keep_node_types(graph: Graph, types: list[str]) -> Graph:
    """Only nodes of these types; edges stay as they are."""
    return Graph(graph.nodes.filter(F.col("type").isin(types)), graph.edges)


def keep_edge_types(graph: Graph, types: list[str]) -> Graph:
    return Graph(graph.nodes, graph.edges.filter(F.col("type").isin(types)))


def search_with_types(graph: Graph, query: str, node_types: list[str] | None = None,
                      edge_types: list[str] | None = None) -> Graph:
    """Type filters of a search result; a blank query gives the empty graph."""
    if not query or not query.strip():
        return empty_like(graph)
    if node_types:
        graph = keep_node_types(graph, node_types)
    if edge_types:
        graph = keep_edge_types(graph, edge_types)
    return graph


def drop_content(graph: Graph, keyword: str) -> Graph:
    """Drop works whose genres mention the keyword, and the edges at them; other nodes stay."""
    flagged = (F.col("type") == "work") & mentions(keyword, "genres", "genre")
    gone = graph.nodes.filter(flagged).select("id")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(graph.nodes.filter(~flagged), edges.select(*graph.edges.columns), graph.held)


def without_genre(works: DataFrame, genre: str) -> DataFrame:
    """Works that do not list exactly this genre (applied before any limit)."""
    return works.filter(~F.array_contains(F.coalesce("genres", F.array().cast("array<string>")), genre))


def min_volumes(works: DataFrame, least: int) -> DataFrame:
    """Works with at least this many volumes; all of them when none qualifies."""
    enough = F.coalesce(F.col("total_volumes") >= least, F.lit(False))
    best = works.select(F.max("total_volumes").alias("m")).scalar()
    return works.withColumn("_best", best).filter(enough | F.coalesce(F.col("_best") < least, F.lit(True))).drop("_best")


def needing_covers(works: DataFrame) -> DataFrame:
    """Works with an ISBN and no cover."""
    return works.filter(
        (F.coalesce("isbn", F.lit("")) != "") & (F.coalesce("cover_image_url", F.lit("")) == "")
    )
