"""Neighbourhood expansion and graph assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.graph import PUBLISHED_BY, PUBLISHED_IN, Graph, edge_id
from shelfgraph.operators.limits import first_per_key
from shelfgraph.session import spread


def _edges_at(graph: Graph, end: str, ids: DataFrame | str, type_: str | None = None) -> DataFrame:
    """Edges whose ``end`` is one of ``ids(id)``, or a known id, from the copy of the edges that lies in order of that end."""
    placed = graph.by_src if end == "src" else graph.by_dst
    if placed is not None:
        edges = placed.having([ids]) if isinstance(ids, str) else placed.matching(ids.select("id"))
        return edges if type_ is None else edges.filter(F.col("type") == type_)
    edges = graph.edges if type_ is None else graph.edges.filter(F.col("type") == type_)
    return edges.filter(F.col(end) == ids) if isinstance(ids, str) else edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")


def incident_edges(graph: Graph, ids: DataFrame | str) -> DataFrame:
    """Edges touching any of ``ids(id)``, or one known id, with that end in ``end`` and the far one in ``other``.

    Over a stored graph, each end's edges come from the copy that lies by that end, out of the files whose range holds an id; a job looks
    up these files, so the ids should be kept. Edges that are only there once, or computed, are read once: each is offered under both of its ends.
    """
    if graph.by_src is None and not isinstance(ids, str):
        both = graph.edges.withColumn("end", F.explode(F.array("src", "dst")))
        found = both.join(ids.select(F.col("id").alias("end")), "end", "left_semi")
        return found.withColumn("other", F.when(F.col("end") == F.col("src"), F.col("dst")).otherwise(F.col("src")))
    out = _edges_at(graph, "src", ids).withColumn("end", F.col("src")).withColumn("other", F.col("dst"))
    into = _edges_at(graph, "dst", ids).withColumn("end", F.col("dst")).withColumn("other", F.col("src"))
    return out.unionByName(into)


def publisher_hop(graph: Graph, touching: DataFrame, ids: DataFrame) -> DataFrame:
    """PUBLISHED_BY edges of the magazines that the works ``ids(id)`` appear in, by their ``touching`` edges."""
    own = touching.filter(F.col("type") == PUBLISHED_IN).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return _edges_at(graph, "src", own.select(F.col("dst").alias("id")).distinct(), PUBLISHED_BY)


def expand(graph: Graph, seeds: DataFrame, with_publishers: bool = True, known_id: str | None = None) -> Graph:
    """Seeds, their neighbours in either direction, and optionally the publishers of their magazines.

    ``seeds`` are the node rows of a limited result (``known_id`` if it is one node of known id); node ids in ``graph`` are unique.
    The seeds and their edges are read several times, so they are kept until the result is released.
    """
    seeds = seeds.persist()
    # Copies of an edge are equal in every column, and distinct is a hash aggregate where picking a row per id would sort.
    near = incident_edges(graph, known_id or seeds)
    if known_id is not None:  # an id that is no seed has edges too
        near = near.join(seeds.select(F.col("id").alias("end")), "end", "left_semi")
    near = near.drop("end", "other").distinct().persist()
    edges = near.unionByName(publisher_hop(graph, near, seeds)).distinct().persist() if with_publishers else near
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    neighbours = graph.nodes_of(ends).join(seeds.select("id"), "id", "left_anti")
    return Graph(seeds.unionByName(neighbours, allowMissingColumns=True), edges, held=(seeds, near, edges))


def assemble(node_parts: list[DataFrame], edge_parts: list[DataFrame]) -> Graph:
    """One graph out of parts; the earliest part wins where an id occurs in several."""

    def whole(parts: list[DataFrame]) -> DataFrame:
        tagged = [p.withColumn("_prio", F.lit(i)) for i, p in enumerate(parts)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

    def firsts(rows: DataFrame, *keys: str) -> DataFrame:
        ties = [F.col(c) for c in ("type", "label", "src", "dst") if c in rows.columns]
        return first_per_key(rows, [*keys, "id"], [F.col("_prio"), *ties]).drop("_prio", *keys)

    edges = whole(edge_parts)
    if not {"src", "type", "dst"} <= set(edges.columns):
        return Graph(firsts(whole(node_parts)), firsts(edges))
    # An id that is the digest of its edge is the longest column and does not pack: it stays behind and is worked out again where the rows meet.
    made, key = F.col("id").eqNullSafe(edge_id("src", "type", "dst")), F.xxhash64("id")
    short = edges.withColumns({"_made": made, "_key": key}).withColumn("id", F.when(~F.col("_made"), F.col("id")))
    met = spread(short, "_key").withColumn("id", F.when(F.col("_made"), edge_id("src", "type", "dst")).otherwise(F.col("id"))).drop("_made")
    return Graph(firsts(whole(node_parts)), firsts(met, "_key").select(*edges.drop("_prio").columns))


def merge_graphs(*graphs: Graph) -> Graph:
    """Union of graphs by id, the first graph winning; releasing it releases the parts."""
    merged = assemble([g.nodes for g in graphs], [g.edges for g in graphs])
    return Graph(merged.nodes, merged.edges, held=tuple(df for g in graphs for df in g.held))


def linked(graph: Graph, edge_type: str, to_id: str | None = None) -> DataFrame:
    """Edges of one type, optionally only those ending in one node."""
    if to_id is None:
        return graph.edges.filter(F.col("type") == edge_type)
    return _edges_at(graph, "dst", to_id, edge_type)


def sources_of(graph: Graph, edge_type: str, target_id: str, node_type: str) -> DataFrame:
    """Nodes with an edge of this type into one node (author to works, magazine to works, ...)."""
    ends = linked(graph, edge_type, target_id).select(F.col("src").alias("id")).distinct()
    return graph.nodes_of(ends).filter(F.col("type") == node_type)
