"""The graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.session import staged
from shelfgraph.sources.keyed_files import FILE_ROWS, KeyedFiles

# Edge vocabulary of the stored graph (fixed values).
CREATED_BY = "CREATED_BY"
PUBLISHED_IN = "PUBLISHED_IN"
PUBLISHED_BY = "PUBLISHED_BY"
PRODUCED_BY = "PRODUCED_BY"
RELATED_TO = "RELATED_TO"

# Column names of the graph-shaped results.
NODE_KEY = ["id", "type", "label"]
EDGE_KEY = ["id", "src", "dst", "type"]


def edge_id(src, type_, dst) -> Column:
    """Stable edge id, a digest of source, type and target."""
    return F.sha2(F.concat_ws("\u0001", src, type_, dst), 256)


@dataclass(frozen=True)
class Graph:
    """``nodes(id, type, label, <property columns>)`` and ``edges(id, src, dst, type, <...>)``.

    Properties are plain nullable columns, so column pruning and predicate pushdown reach the files.
    Both frames stay lazy; counting them is an action of the caller. A stored graph also has its nodes by id, and its edges twice, by ranges of
    the source and of the target, with directories of the files: nodes and edges of few ids are read from the files that hold them.
    """

    nodes: DataFrame
    edges: DataFrame
    held: tuple[DataFrame, ...] = ()
    by_id: KeyedFiles | None = None
    by_src: KeyedFiles | None = None
    by_dst: KeyedFiles | None = None
    few: Callable[[DataFrame], DataFrame] | None = None

    def release(self) -> None:
        """Free all rows an operator kept for reuse (they spill, and are recomputed when lost)."""
        for df in self.held:
            df.unpersist()

    def of_type(self, type_: str) -> DataFrame:
        return self.nodes.filter(F.col("type") == type_)

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types))

    def node_rows(self) -> DataFrame:
        return self.nodes.select(*NODE_KEY)

    def edge_rows(self) -> DataFrame:
        return self.edges.select("src", "dst", "type")

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        """The nodes whose id is in ``ids(id)``."""
        return self.nodes.join(ids, "id", "left_semi") if self.by_id is None else self.by_id.matching(ids)

    def few_nodes(self, ids: DataFrame) -> DataFrame:
        """The same for the few ids of a limited result: a derived graph (``few``) makes these nodes only."""
        return self.nodes_of(ids) if self.few is None else self.few(ids)

    def write(self, path: str, file_rows: int = FILE_ROWS) -> None:
        """Store the graph. Nodes are read several times, so expensive ones should be staged."""
        write_nodes(self.nodes, path, file_rows)
        write_edges(self.edges, path, file_rows)

    @staticmethod
    def read(spark, path: str) -> "Graph":
        by_id = KeyedFiles.open(spark, f"{path}/nodes", "id")
        by_src, by_dst = (KeyedFiles.open(spark, f"{path}/{name}", key, shown=_with_ids) for name, key in (("edges", "src"), ("edges_in", "dst")))
        return Graph(by_id.all(), by_src.all(), by_id=by_id, by_src=by_src, by_dst=by_dst)


def write_nodes(nodes: DataFrame, path: str, file_rows: int = FILE_ROWS) -> KeyedFiles:
    """The nodes of a stored graph."""
    return KeyedFiles.write(nodes, f"{path}/nodes", "id", partition_by="type", file_rows=file_rows)


def write_edges(edges: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """The edges of a stored graph by either end. An id that is the digest of its edge is the longest column: it is not stored but worked out by the reader."""
    made = F.col("id").eqNullSafe(edge_id("src", "type", "dst"))
    short = edges.withColumn("made_id", made).withColumn("id", F.when(~F.col("made_id"), F.col("id"))).select(*edges.columns, "made_id")
    short = staged(short, "edges")
    KeyedFiles.write(short, f"{path}/edges", "src", "type", "dst", "id", file_rows=file_rows)
    KeyedFiles.write(short, f"{path}/edges_in", "dst", "type", "src", "id", file_rows=file_rows)


def _with_ids(stored: DataFrame) -> DataFrame:
    return stored.withColumn("id", F.when(F.col("made_id"), edge_id("src", "type", "dst")).otherwise(F.col("id"))).drop("made_id")


def empty_like(graph: Graph) -> Graph:
    return Graph(graph.nodes.filter(F.lit(False)), graph.edges.filter(F.lit(False)))
