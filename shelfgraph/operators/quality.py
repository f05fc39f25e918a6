"""Counts, coverage, duplicates and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.names import script_priority
from shelfgraph.graph import Graph, edge_id
from shelfgraph.operators.limits import first_per_key, look_up, top_rows
from shelfgraph.operators.upsert import without_ends

# Import stages in order (fixed values).
STAGES = ["publisher", "author", "magazine", "work"]


def node_counts(nodes: DataFrame, labels: str | None = None) -> DataFrame:
    """Nodes per type; a node with several labels counts under each."""
    per = nodes.select(F.explode(labels).alias("type")) if labels else nodes.select("type")
    return per.groupBy("type").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def totals(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes"))
    e = graph.edges.agg(F.count("*").alias("n")).withColumn("what", F.lit("edges"))
    return n.unionByName(e)


def statistics(graph: Graph) -> DataFrame:
    """The six counters of the catalogue as (counter, value) rows."""
    t = F.col("type")
    is_series = F.coalesce(F.col("total_volumes") > 1, F.lit(False))
    nodes = graph.nodes.agg(
        F.count_if(t == "work").alias("work_count"), F.count_if(t == "author").alias("author_count"),
        F.count_if(t == "publisher").alias("publisher_count"),
        F.count_if((t == "work") & is_series).alias("series_count"),
    )
    edges = graph.edges.agg(
        F.count_if(t == "CREATED_BY").alias("created_relationships"),
        F.count_if(t.isin("PUBLISHED_BY", "PUBLISHED_IN")).alias("published_relationships"),
    )
    rows = lambda df: df.unpivot([], df.columns, "counter", "value")
    return rows(nodes).unionByName(rows(edges))


def _filled(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _with_type(df: DataFrame, keys: list[str]) -> list[str]:
    """Nodes of different types are never copies of each other."""
    return ["type", *keys] if "type" in df.columns and "type" not in keys else keys


def duplicate_report(nodes: DataFrame, keys: list[str], top: int | None = None, only_without: str | None = None) -> DataFrame:
    """The keys with copies, most copies first, or the ``top`` ones if a number is asked for.

    ``only_without`` names a column that must be null: the pass by name looks at nodes without a business id.
    """
    keys = _with_type(nodes, keys)
    rows = nodes.filter(_filled(keys)) if only_without is None else nodes.filter(_filled(keys) & F.col(only_without).isNull())
    counted = rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    order = [F.col("copies").desc(), *[F.col(k) for k in keys]]
    return counted.orderBy(*order) if top is None else top_rows(counted, top, *order)


def surplus_rows(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with copies, and the rows a clean-up would remove."""
    keys = _with_type(nodes, keys)
    per = nodes.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return per.agg(F.count("*").alias("duplicated_keys"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus"))


def drop_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key."""
    return first_per_key(df, keys, order)


def dedupe_graph(graph: Graph, keys: list[str], rewire: bool = False, only_without: str | None = None) -> Graph:
    """Keep the node with the lowest id per type and key; edges of the others go, or move to the kept node.

    Nodes with a null key are left alone, and with ``only_without`` those that have a value in that column. Edges that move get
    the id of their new ends; of edges that become one, the one with the lowest old id gives the other columns.
    """
    keys = _with_type(graph.nodes, keys)
    filled = _filled(keys) if only_without is None else _filled(keys) & F.col(only_without).isNull()
    keyed = graph.nodes.filter(filled)
    keep = keyed.groupBy(*keys).agg(F.min("id").alias("_keep"))
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}") == F.col(f"k.{k}") for k in keys])
    renamed = (
        keyed.alias("n").join(keep.alias("k"), same).select(F.col("n.id").alias("id"), "_keep")
        .filter(F.col("id") != F.col("_keep"))
    )
    nodes = graph.nodes.join(renamed.select("id"), "id", "left_anti")
    if not rewire:
        return Graph(nodes, without_ends(graph.edges, renamed.select("id")))
    # An id that is the digest of its edge does not pack: it stays behind and is worked out again from the old ends.
    old = {"_src": F.col("src"), "_dst": F.col("dst"), "_made": F.col("id").eqNullSafe(edge_id("src", "type", "dst"))}
    edges = graph.edges.withColumns({**old, "_moved": F.lit(False)}).withColumn("id", F.when(~F.col("_made"), F.col("id")))
    for end, other in (("src", "dst"), ("dst", "src")):
        to = renamed.select(F.col("id").alias(end), F.col("_keep").alias("_to"))
        edges = look_up(edges, end, other, to).withColumn("_moved", F.col("_moved") | F.col("_to").isNotNull())
        edges = edges.withColumn(end, F.coalesce("_to", end)).drop("_to")
    edges = edges.withColumn("id", F.when(F.col("_made"), edge_id("_src", "type", "_dst")).otherwise(F.col("id"))).drop("_src", "_dst", "_made")
    first = first_per_key(edges, ["src", "dst", "type"], [F.col("id").asc_nulls_last(), F.col("_moved")])
    moved = first.withColumn("id", F.when(F.col("_moved"), edge_id("src", "type", "dst")).otherwise(F.col("id")))
    return Graph(nodes, moved.select(*graph.edges.columns))


def coverage(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Rows, rows with the column, and their share in percent (0 for no rows)."""
    total, filled = F.count("*"), F.count(F.col(column))
    share = F.when(total == 0, 0.0).otherwise(F.round(100.0 * filled / F.nullif(total, F.lit(0)), 2))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(total.alias("total"), filled.alias("with_value"), share.alias("percentage"))


def import_progress(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Progress per type against ``expected(type, expected)``, at most 100 %, with its state."""
    e = expected.select("type", "expected")
    share = F.least(F.lit(100.0), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.nullif("expected", F.lit(0)), 2))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "waiting").when(F.col("n") >= F.col("expected"), "done").otherwise("running")
    return e.join(counts, "type", "left").select(
        "type", F.coalesce("n", F.lit(0)).alias("n"), "expected", F.coalesce(share, F.lit(0.0)).alias("progress"),
        state.alias("state"),
    )


def current_stage(progress: DataFrame) -> DataFrame:
    """The first stage of an import that is not done, or ``complete``."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("type"))
    open_ = F.when(F.col("state") != "done", F.col("type"))
    return progress.agg(F.coalesce(F.min_by(open_, F.when(open_.isNotNull(), order)), F.lit("complete")).alias("stage"))


def distinct_values(df: DataFrame, values: Column, field: str) -> DataFrame:
    """Distinct entries of an array expression, as (field, value)."""
    return df.select(F.explode(values).alias("value")).distinct().select(F.lit(field).alias("field"), "value")


def role_profile(names: DataFrame, column: str) -> DataFrame:
    """How often each role prefix occurs; '' for names without one."""
    role = F.regexp_extract(column, r"^(\[+[^\]]*\]+)", 1)
    return names.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def script_profile(names: DataFrame, column: str) -> DataFrame:
    return names.groupBy(script_priority(column).alias("script")).agg(F.count("*").alias("n"))


def special_titles(works: DataFrame, column: str, pattern: str = r"[^\p{L}\p{N}\s]") -> DataFrame:
    return works.filter(F.col(column).rlike(pattern))
