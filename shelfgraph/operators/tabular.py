"""Graphs out of denormalised catalogue rows.

Rows are ``uri, title, creator_uri, creator_name, genre, publisher, published_date`` and, where a
function says so, ``magazine_uri, magazine_name, publisher_uri, publisher_name, type``. This family uses
lower-case edge types that point from the maker to the work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.names import entity_id
from shelfgraph.functions.nodes import publication_year
from shelfgraph.functions.text import contains_ci, strip
from shelfgraph.graph import Graph
from shelfgraph.operators.limits import first_per_key, top_rows

# Fixed values.
URI_TYPES = [("author", ("creator", "author")), ("work", ("work",)), ("magazine", ("magazine", "periodical"))]
SOURCE = "media_arts_db"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def catalogue_rows(works: DataFrame, credits: DataFrame) -> DataFrame:
    """The denormalised view: one row per work and creator, with one publisher name."""
    creators = credits.filter("kind = 'creator'").select(F.col("work_id").alias("uri"), F.col("name").alias("creator_name"))
    publishers = credits.filter("kind = 'publisher'").groupBy(F.col("work_id").alias("uri")).agg(F.min("name").alias("publisher"))
    return (
        works.select(F.col("id").alias("uri"), F.col("title_name").alias("title"), "genre",
                     F.col("first_published").alias("published_date"))
        .join(creators, "uri", "left").join(publishers, "uri", "left")
        .withColumn("creator_uri", F.concat(F.lit("creator:"), "creator_name"))
    )


@dataclass(frozen=True)
class CatalogueView:
    """The denormalised view of works and credits that are made on request, all of them or those of few works ``ids(id)``.

    A limited lookup finds its works first, so the lines behind works and credits are grouped and joined for these only.
    """

    works: Callable[[DataFrame | None], DataFrame]
    credits: Callable[[DataFrame | None], DataFrame]

    def rows(self) -> DataFrame:
        return catalogue_rows(self.works(None), self.credits(None))

    def rows_of(self, ids: DataFrame) -> DataFrame:
        return catalogue_rows(self.works(ids), self.credits(ids))


def rows_by_title(rows: DataFrame | CatalogueView, term: str, limit: int) -> DataFrame:
    """The first rows by uri and creator whose title contains the term.

    Every work has a row, so in a view they are rows of the first works found. ``distinct`` lets Spark leave out what else works are joined with.
    """
    if isinstance(rows, CatalogueView):
        titled = rows.works(None).filter(contains_ci("title_name", term)).select("id").distinct()
        rows = rows.rows_of(top_rows(titled, limit, F.col("id")))
    return top_rows(rows.filter(contains_ci("title", term)), limit, F.col("uri"), F.col("creator_uri"))


def rows_by_creator(rows: DataFrame, name: str, limit: int) -> DataFrame:
    return top_rows(rows.filter(contains_ci("creator_name", name)), limit, F.col("uri"), F.col("creator_uri"))


def _nodes(rows: DataFrame, type_: str, id_: str, label: Column, **props) -> DataFrame:
    picked = rows.filter(_filled(id_)).select(
        F.col(id_).alias("id"), F.lit(type_).alias("type"), label.alias("label"), *[v.alias(k) for k, v in props.items()]
    )
    order = [F.col(c) for c in picked.columns if c not in ("id", "type")]
    return first_per_key(picked, ["id"], order).withColumn("source", F.lit(SOURCE))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _works(rows: DataFrame, label: Column) -> DataFrame:
    return _nodes(rows, "work", "uri", label, title=_text("title"), genre=_text("genre"), publisher=_text("publisher"),
                  published_date=_text("published_date"))


def _authors(rows: DataFrame) -> DataFrame:
    return _nodes(rows, "author", "creator_uri", F.coalesce("creator_name", F.lit("Unknown Creator")), name=_text("creator_name"))


def _links(rows: DataFrame, src: str, type_: str, dst: str) -> DataFrame:
    pairs = rows.filter(_filled(src) & _filled(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    return pairs.select(F.concat_ws("-", "src", F.lit(type_), "dst").alias("id"), "src", "dst", F.lit(type_).alias("type"),
                        F.lit(SOURCE).alias("source"))


def works_and_authors(rows: DataFrame) -> Graph:
    """Search result: the first row of each title gives a work, its creator and their edge."""
    titled = rows.withColumn("title", strip(_text("title"))).filter(F.col("title") != "")
    kept = first_per_key(titled, ["title"], [F.col("uri"), F.col("creator_uri")])
    return Graph(_works(kept, F.col("title")).unionByName(_authors(kept), allowMissingColumns=True),
                 _links(kept, "creator_uri", "created", "uri"))


def creator_and_works(rows: DataFrame) -> Graph:
    """All rows of a creator lookup as creators, works and their edges."""
    works = _works(rows, F.coalesce("title", F.lit("Unknown Work")))
    return Graph(_authors(rows).unionByName(works, allowMissingColumns=True), _links(rows, "creator_uri", "created", "uri"))


def named_creator_works(works: DataFrame, name: str) -> Graph:
    """The same from found works ``(id, label, ...)`` of a creator known by name only."""
    found = works.select("id").limit(1).select(entity_id(F.lit(name), "author").alias("id"), F.lit("author").alias("type"),
                                               F.lit(name).alias("label"), F.lit(name).alias("name"))
    pairs = works.select(F.lit(name).alias("n"), F.col("id").alias("dst")).select(entity_id("n", "author").alias("src"), "dst")
    return Graph(found.unionByName(works, allowMissingColumns=True), _links(pairs, "src", "created", "dst"))


def magazines_and_publishers(rows: DataFrame) -> Graph:
    """Rows ``(uri, title, genre, publisher_uri, publisher_name)`` of a magazine listing."""
    magazines = _nodes(rows, "magazine", "uri", F.coalesce("title", F.lit("Unknown Magazine")), title=_text("title"), genre=_text("genre"))
    publishers = _nodes(rows, "publisher", "publisher_uri", F.coalesce("publisher_name", F.lit("Unknown Publisher")), name=_text("publisher_name"))
    return Graph(magazines.unionByName(publishers, allowMissingColumns=True), _links(rows, "publisher_uri", "publishes", "uri"))


def rows_by_magazine(rows: DataFrame, magazine: str | None, year: str | None, limit: int) -> DataFrame:
    """Rows of magazines whose name contains the text and whose work started in the year."""
    kept = rows
    if magazine:
        kept = kept.filter(contains_ci("magazine_name", magazine))
    if year:
        kept = kept.filter(publication_year("published_date") == year)
    return top_rows(kept, limit, F.col("uri"), F.col("creator_uri"), F.col("magazine_uri"))


def magazine_relationships(rows: DataFrame) -> Graph:
    works = _works(rows, F.coalesce("title", F.lit("Unknown Work")))
    magazines = _nodes(rows, "magazine", "magazine_uri", F.coalesce("magazine_name", F.lit("Unknown Magazine")), name=_text("magazine_name"))
    nodes = works.unionByName(_authors(rows), allowMissingColumns=True).unionByName(magazines, allowMissingColumns=True)
    return Graph(nodes, _links(rows, "creator_uri", "created", "uri").unionByName(_links(rows, "magazine_uri", "published", "uri")))


def type_from_uri(uri) -> Column:
    low, expr = F.lower(uri), F
    for type_, marks in URI_TYPES:
        test = low.contains(marks[0])
        for m in marks[1:]:
            test = test | low.contains(m)
        expr = expr.when(test, type_)
    return expr.otherwise("unknown")


def typed_results(rows: DataFrame) -> DataFrame:
    """Full-text rows ``(uri, title, type)`` as nodes whose type comes from the uri."""
    picked = rows.filter(_filled("uri")).select(
        F.col("uri").alias("id"), type_from_uri(F.col("uri")).alias("type"), F.coalesce("title", F.lit("Unknown")).alias("label"),
        F.col("type").alias("resource_type"))
    return first_per_key(picked, ["id"], [F.col("label"), F.col("resource_type")])


def append_related(graph: Graph, rows: DataFrame, relation: str) -> Graph:
    """Graph with the works and creators of related rows; publishers too for ``published_by``."""
    fresh = _works(rows.withColumn("title", strip(_text("title"))),
                   F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Work")))
    nodes = fresh.unionByName(_authors(rows), allowMissingColumns=True)
    edges = _links(rows, "creator_uri", "created", "uri")
    if relation == "published_by":
        named = rows.withColumn("publisher", strip(_text("publisher"))).filter(F.col("publisher") != "").withColumn(
            "publisher_id", entity_id("publisher", "publisher"))
        nodes = nodes.unionByName(_nodes(named, "publisher", "publisher_id", F.col("publisher"), name=F.col("publisher")), allowMissingColumns=True)
        edges = edges.unionByName(_links(named, "publisher_id", "publishes", "uri"))
    added = nodes.join(graph.nodes.select("id"), "id", "left_anti")
    more = edges.join(graph.edges.select("id"), "id", "left_anti")
    return Graph(graph.nodes.unionByName(added, allowMissingColumns=True), graph.edges.unionByName(more, allowMissingColumns=True))


def search_with_related(rows: DataFrame | CatalogueView, term: str, limit: int, overlapping: DataFrame, fallback_titles: list[str] = (),
                        per_title: int | None = None, when_at_most: int | None = None) -> Graph:
    """Title search with the works that overlap its period and, where asked for, works of given titles.

    ``overlapping`` are catalogue rows of the overlap lookup. ``per_title`` works of each fallback title not named in the term are added;
    with ``when_at_most``, only if the result has no more nodes than that, which is decided inside the plan.
    """
    if fallback_titles and per_title is None:
        raise ValueError("per_title is needed with fallback titles")
    near, found = overlapping.persist(), rows_by_title(rows, term, limit).persist()
    graph = append_related(works_and_authors(found), near, "overlap_period")
    held = [near, found]
    if when_at_most is not None:
        few = graph.nodes.select(F.count("*") <= when_at_most).scalar()
    for title in fallback_titles:
        if title.lower() not in term.lower():
            more = rows_by_title(rows, title, per_title)
            if when_at_most is not None:
                more = more.withColumn("_few", few).filter("_few").drop("_few")
            more = more.persist()
            held.append(more)
            graph = append_related(graph, more, "same_publisher")
    return Graph(graph.nodes, graph.edges, held=tuple(held))
