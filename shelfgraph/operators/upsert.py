"""Keyed upserts, edge merges, deletes, snapshot copies and exports as plain joins.

Parquet has no MERGE: each function returns the new version of the table, and ``publish`` writes it
next to the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.graph import Graph, edge_id
from shelfgraph.operators.limits import first_per_key, look_up


def last_filled_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: for every column its last non-null value in ``order``.

    This is what merging the rows one after another leaves. It is a hash aggregate with map-side
    combine, so a key with very many rows is reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    )


def _paired(target: DataFrame, source: DataFrame, key: str, how: str) -> tuple[DataFrame, list[str], list[str]]:
    src = source.select(F.col(key).alias("_key"), F.lit(True).alias("_new"),
                        *[F.col(c).alias("_s_" + c) for c in source.columns if c != key])
    old = target.withColumn("_old", F.lit(True))
    joined = old.join(src, F.col(key) == F.col("_key"), how)
    return joined, [c for c in source.columns if c != key], target.columns


def upsert_merge(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Insert or update by key: an incoming non-null value wins, anything else keeps the old one.

    ``source`` has one row per key (see ``last_filled_per_key``); columns only it has are added.
    """
    joined, new, old = _paired(target, source, key, "full")
    cols = [F.coalesce(F.col(key), F.col("_key")).alias(key)]
    for c in [c for c in old if c != key] + [c for c in new if c not in old]:
        sides = (["_s_" + c] if c in new else []) + ([c] if c in old else [])
        cols.append(F.coalesce(*sides).alias(c))
    return joined.select(*cols)


def insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Insert rows with a new key; rows already there keep all their values, nulls included."""
    fresh = source.join(target.select(key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def update_existing(target: DataFrame, source: DataFrame, key: str, nulls_overwrite: bool = False) -> DataFrame:
    """Update rows whose key exists; new keys are ignored. Nulls overwrite only when asked to."""
    joined, new, old = _paired(target, source, key, "left")
    cols = []
    for c in old + [c for c in new if c not in old]:
        if c == key or c not in new:
            cols.append(F.col(c))
            continue
        was = F.col(c) if c in old else F.lit(None)
        now = F.col("_s_" + c)
        cols.append((F.when(F.col("_new"), now).otherwise(was) if nulls_overwrite else F.coalesce(now, was)).alias(c))
    return joined.select(*cols)


def matched_count(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.join(source.select(key), key, "left_semi").agg(F.count("*").alias("matched"))


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored edges plus each new (src, dst, type) once, where both ends exist."""
    ids = nodes.select("id")
    key = ["src", "dst", "type"]
    # The three joins key on different columns; AQE broadcasts any side that turns out small.
    fresh = (
        new.select(*key).distinct()
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .join(edges.select(*key), key, "left_anti")
        .withColumn("id", edge_id(F.col("src"), F.col("type"), F.col("dst")))
    )
    return edges.unionByName(fresh, allowMissingColumns=True)


def dangling_edges(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end that is not a node."""
    ids = nodes.select("id").withColumn("_there", F.lit(True))
    return (
        new.join(ids.select(F.col("id").alias("src"), F.col("_there").alias("_s")), "src", "left")
        .join(ids.select(F.col("id").alias("dst"), F.col("_there").alias("_d")), "dst", "left")
        .filter(F.col("_s").isNull() | F.col("_d").isNull()).select(*new.columns)
    )


def link_lists(rows: DataFrame, key: str, lists: dict[str, tuple[str, str]]) -> Graph:
    """Nodes and edges of list columns: ``{column: (node type, edge type)}``, ends created as needed."""
    links = [
        rows.select(F.col(key).alias("src"), F.explode(c).alias("name")).filter(F.col("name").isNotNull())
        .select("src", "name", F.lit(node_type).alias("node_type"), F.lit(edge_type).alias("type"))
        for c, (node_type, edge_type) in lists.items()
    ]
    pairs = reduce(lambda a, b: a.unionByName(b), links).distinct().withColumn(
        "dst", F.concat_ws(":", "node_type", "name")
    )
    ends = pairs.select(F.col("dst").alias("id"), F.col("node_type").alias("type"), F.col("name").alias("label")).distinct()
    own = rows.select(F.col(key).alias("id"), F.lit("work").alias("type"), F.col(key).alias("label")).distinct()
    edges = pairs.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "src", "dst", "type")
    return Graph(own.unionByName(ends), edges)


def delete_nodes(graph: Graph, node_types: list[str]) -> Graph:
    """Delete nodes of these types with every edge at them."""
    gone = graph.nodes.filter(F.col("type").isin(node_types)).select("id")
    return Graph(graph.nodes.filter(~F.col("type").isin(node_types)), without_ends(graph.edges, gone))


def without_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ``ids(id)``."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return out.select(*edges.columns)


def delete_edges(graph: Graph, edge_types: list[str]) -> Graph:
    return Graph(graph.nodes, graph.edges.filter(~F.col("type").isin(edge_types)))


def drop_properties(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rows_with_any(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have a value in at least one of the columns."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return df.agg(F.count_if(some).alias("affected"))


def copy_graph(graph: Graph, new_id: Column, skip_prefix: str = "embedding_") -> tuple[Graph, DataFrame]:
    """A copy under new ids without the embedding columns, its edges with the ids of their new ends, and the edges that lost an end.

    ``new_id`` is an expression over the node columns.
    """
    keep = [c for c in graph.nodes.columns if not c.startswith(skip_prefix) and c != "id"]
    renamed = graph.nodes.withColumn("_migration_id", F.col("id"))
    nodes = renamed.select(new_id.alias("id"), "_migration_id", *keep)
    ids = nodes.select("_migration_id", F.col("id").alias("_to"))
    mapped = graph.edges
    for end, other in (("src", "dst"), ("dst", "src")):
        side = ids.select(F.col("_migration_id").alias(end), F.col("_to").alias("_" + end))
        mapped = look_up(mapped, end, other, side)
    lost = F.col("_src").isNull() | F.col("_dst").isNull()
    rest = [c for c in graph.edges.columns if c not in ("id", "src", "dst")]
    edges = mapped.filter(~lost).select(edge_id("_src", "type", "_dst").alias("id"), *rest, F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return Graph(nodes, edges), mapped.filter(lost).select(*graph.edges.columns)


def rekey_edges(rows: DataFrame, nodes: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Edges matched to nodes by business key: works by id, other nodes by name.

    ``rows(src_type, src_id, src_name, dst_type, dst_id, dst_name, type, <props>, order)``;
    ``nodes(id, type, work_id, name)`` is unique per type and key. The last row in ``order`` replaces the
    properties of an edge written twice. Returns the edges and the rows that matched nothing.
    """
    def key(prefix: str) -> Column:
        return F.when(F.col(prefix + "type") == "work", F.col(prefix + "id")).otherwise(F.col(prefix + "name"))

    known = nodes.select(
        F.col("type").alias("_type"),
        F.when(F.col("type") == "work", F.col("work_id")).otherwise(F.col("name")).alias("_k"), F.col("id").alias("_id"),
    )
    # Rows without a key match nothing; in the joins they would all meet in one partition.
    whole = key("src_").isNotNull() & key("dst_").isNotNull() & F.col("src_type").isNotNull() & F.col("dst_type").isNotNull()
    keyless = rows.filter(~whole)
    out = rows.filter(whole)
    for side in ("src", "dst"):
        k = known.select(F.col("_type").alias(f"_{side}_type"), F.col("_k").alias(f"_{side}_k"), F.col("_id").alias(side))
        out = out.join(
            k, (F.col(f"{side}_type") == F.col(f"_{side}_type")) & (key(side + "_") == F.col(f"_{side}_k")), "left"
        ).drop(f"_{side}_type", f"_{side}_k")
    failed = F.col("src").isNull() | F.col("dst").isNull()
    edges = first_per_key(out.filter(~failed), ["src", "dst", "type"], [F.col(order).desc()])
    return edges, out.filter(failed).select(*rows.columns).unionByName(keyless)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null keys held by more than one row."""
    filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(filled).groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise when a key occurs twice (runs a job that stops at the first such key)."""
    found = duplicate_keys(df, keys).take(1)
    if found:
        raise ValueError(f"duplicate key {found[0].asDict()}")


def publish(df: DataFrame, path: str, version: int) -> str:
    """Write one version of a table; an interrupted write can simply be repeated."""
    out = version_path(path, version)
    df.write.mode("overwrite").parquet(out)
    return out


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version:012d}"


def export_with_metadata(df: DataFrame, path: str, **facts) -> None:
    """Rows and a one-row envelope ``{counts, facts}`` as JSON folders."""
    df.write.mode("overwrite").json(f"{path}/rows")
    envelope(df, **facts).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def envelope(df: DataFrame, **facts) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.lit(v).alias(k) for k, v in facts.items()])
