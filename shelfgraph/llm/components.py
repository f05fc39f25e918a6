"""Connected components of an edge table.

Each task first reduces its edges to a spanning forest of stars around the smallest nodes; the number of tasks follows from the number
of edges. One task is then done; several tasks' stars are joined by rounds in which the smallest labels spread along the edges and
jump to their labels' labels, so the rounds grow with the logarithm of the longest path of stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.session import staged

EDGES_PER_TASK = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (smallest node, node) of the components of one task's edges, the smallest node with itself too."""
    parent: dict = {}
    kind = None

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, two = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if one != two:
                parent[max(one, two)] = min(one, two)
    nodes = list(parent)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k:k + 50_000]
        yield pa.record_batch([pa.array([root(x) for x in part], kind), pa.array(part, kind)], ["a", "b"])


def components(edges: DataFrame, purpose: str = "components", edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b) with different ends; the component is its smallest node.

    Each round writes its labels to the shared folder, so that lineage stays short and a lost executor costs one round. Nothing is
    collected, and no task holds more than its share of the edges.
    """
    kind = edges.schema["a"].dataType.simpleString()
    own = edges.select("a", "b").filter(F.col("a") != F.col("b")).mapInArrow(_stars, f"a {kind}, b {kind}")
    pairs = staged(own.filter(F.col("a") != F.col("b")), purpose)
    tasks = -(-pairs.count() // edges_per_task) or 1
    stars = staged(pairs.repartition(tasks).mapInArrow(_stars, f"a {kind}, b {kind}"), purpose)
    if tasks == 1:
        return stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), purpose)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = step.select(F.col("node").alias("via"), F.col("step").alias("component"))
        new = step.join(jump, F.col("step") == F.col("via")).select("node", "component", (F.col("component") != F.col("old")).alias("moved"))
        new = staged(new, purpose)
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels
