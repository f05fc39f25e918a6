"""Node typing, labels, content tests and output forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.names import normalize_publisher
from shelfgraph.functions.text import col, first_filled

EMBEDDING_PREFIX = "embedding"
# Source mark of delivered nodes (fixed value).
STORE_SOURCE = "neo4j"


def infer_type(labels) -> Column:
    """Node type from its labels; work before author before magazine before publisher."""
    ls = col(labels)
    expr = F.when(F.array_contains(ls, "Work"), "work")
    for label in ("Author", "Magazine", "Publisher"):
        expr = expr.when(F.array_contains(ls, label), label.lower())
    return expr.otherwise(F.lower(F.coalesce(F.get(ls, F.lit(0)), F.lit("unknown"))))


# Label fields of each node type in order of preference, and the label when none is filled (fixed values).
LABELS = {
    "work": (("title_name", "english_name", "title", "id"), "Work"),
    "author": (("name", "english_name"), "Author"),
    "magazine": (("name", "title"), "Magazine"),
    "publisher": (("name",), "Publisher"),
    "other": (("name", "title"), "Node"),
}


def derive_label(type_, **fields) -> Column:
    """Display label: the first filled field of the type, else the type's default.

    ``type_`` is one node type as text, or a Column of types; ``fields`` are the columns at hand.
    """
    def label(kind: str) -> Column:
        names, default = LABELS[kind]
        found = [fields[n] for n in names if n in fields]
        return F.coalesce(first_filled(*[col(c).cast("string") for c in found]), F.lit(default)) if found else F.lit(default)

    if isinstance(type_, str):
        return label(type_ if type_ in LABELS else "other")
    expr = F.when(type_ == "work", label("work"))
    for kind in ("author", "magazine", "publisher"):
        expr = expr.when(type_ == kind, label(kind))
    return expr.otherwise(label("other"))


def mentions(keyword: str, genres=None, genre=None) -> Column:
    """Does the genre list, or the genre text when the list is empty, contain the keyword (any case)?"""
    k = keyword.lower()
    in_text = F.lit(False) if genre is None else F.lower(F.coalesce(col(genre), F.lit(""))).contains(k)
    if genres is None:
        return in_text
    filled = F.coalesce(F.size(col(genres)) > 0, F.lit(False))
    in_list = F.exists(col(genres), lambda g: F.lower(F.coalesce(g, F.lit(""))).contains(k))
    return F.when(filled, in_list).otherwise(in_text)


def mentions_in_map(keyword: str, m) -> Column:
    """The same test over the keys and values of a map."""
    k = keyword.lower()
    both = F.concat(F.map_keys(m), F.map_values(m))
    return F.coalesce(F.exists(both, lambda x: F.lower(F.coalesce(x, F.lit(""))).contains(k)), F.lit(False))


def strip_embeddings(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(EMBEDDING_PREFIX)])


def properties_json(*columns) -> Column:
    """JSON text of the given columns, nulls left out."""
    return F.to_json(F.struct(*columns))


def publication_year(c) -> Column:
    """First four characters when they are digits."""
    return F.nullif(F.regexp_extract(col(c), r"^(\d{4})", 1), F.lit(""))


def _or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def output_works(df: DataFrame, source: str = STORE_SOURCE) -> DataFrame:
    """Work rows in the delivery form: defaults filled, a series shown as volume 1, clean publishers."""
    series = _or(df, "is_series", False)
    volume = _or(df, "volume", "")
    counted = _or(df, "work_count", 1).cast("int")
    volumes = F.coalesce(F.col("total_volumes").cast("int"), counted) if "total_volumes" in df.columns else counted
    title = F.coalesce("title", "label") if "title" in df.columns else F.col("label")
    out = df.select(
        "id", "label", F.lit("work").alias("type"), F.lit(source).alias("source"), title.alias("title"),
        _or(df, "published_date", "").alias("published_date"), _or(df, "genre", "").alias("genre"),
        _or(df, "isbn", "").alias("isbn"), F.when(series, "1").otherwise(volume).alias("volume"),
        series.alias("is_series"), counted.alias("work_count"), volumes.alias("total_volumes"),
        F.when(series, _or(df, "series_volumes", "") if "series_volumes" in df.columns else volume).alias("series_volumes"),
        F.when(series, _or(df, "published_date", "")).alias("date_range"),
        *([F.col("publishers")] if "publishers" in df.columns else []),
        *([F.col("creators")] if "creators" in df.columns else []),
    )
    if "publishers" in df.columns:
        clean = F.array_distinct(F.filter(F.transform("publishers", normalize_publisher), lambda p: p != ""))
        out = out.withColumn("publishers", clean)
    return out


def output_edge_id(src, type_, dst) -> Column:
    """Readable edge id of the delivery form."""
    return F.concat_ws("-", col(src), col(type_), col(dst))


def output_nodes(nodes: DataFrame, source: str = STORE_SOURCE) -> DataFrame:
    """Nodes that are no works in the delivery form: (id, label, type, properties); properties is JSON text.

    Authors, magazines and publishers have their label as name; publications their title, date, genre and lists, with defaults.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in nodes.columns else F.lit("")

    def names(name: str) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.col(name), none) if name in nodes.columns else none

    title = F.coalesce("title", "label") if "title" in nodes.columns else F.col("label")
    named = F.to_json(F.struct(F.lit(source).alias("source"), F.col("label").alias("name")))
    publication = F.to_json(F.struct(
        F.lit(source).alias("source"), title.alias("title"), text("publication_date").alias("publication_date"), text("genre").alias("genre"),
        names("creators").alias("creators"), names("magazines").alias("magazines")))
    other = F.to_json(F.struct(F.lit(source).alias("source")))
    properties = F.when(F.col("type").isin("author", "publisher", "magazine"), named).when(F.col("type") == "publication", publication).otherwise(other)
    return nodes.filter(F.col("type") != "work").select("id", "label", "type", properties.alias("properties"))


def output_edges(edges: DataFrame, source: str = STORE_SOURCE) -> DataFrame:
    """Edges in the delivery form: (id, source, target, type, properties); an edge without an id gets one from its ends."""
    made = output_edge_id("src", "type", "dst")
    id_ = F.coalesce("id", made) if "id" in edges.columns else made
    return edges.select(id_.alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "type",
                        F.to_json(F.struct(F.lit(source).alias("source"))).alias("properties"))


# Placeholder covers: publisher mark in the name -> file (fixed values).
PLACEHOLDERS = "/static/images/placeholders/"
PUBLISHER_COVERS = {"集英社": "shueisha", "講談社": "kodansha", "小学館": "shogakukan"}


def placeholder_cover(genre, publisher) -> Column:
    expr = F.when(col(genre).contains("マンガ"), PLACEHOLDERS + "manga-cover.png")
    for mark, name in PUBLISHER_COVERS.items():
        expr = expr.when(col(publisher).contains(mark), f"{PLACEHOLDERS}{name}-cover.png")
    return expr.otherwise(PLACEHOLDERS + "default-cover.png")
