"""Graph building: books to works, author names, magazines of works, related works, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.functions import names as N
from shelfgraph.functions import titles as Ti
from shelfgraph.graph import CREATED_BY, PRODUCED_BY, PUBLISHED_BY, PUBLISHED_IN, RELATED_TO, Graph, edge_id
from shelfgraph.operators.limits import first_per_key
from shelfgraph.operators.linkage import match_series


def with_work_keys(books: DataFrame) -> DataFrame:
    """Books ``(name, volume, ...)`` with ``work_title`` and ``work_key``; books without a title are dropped.

    The title is exploded out of an array of none or one, so it is computed once; a filter on it would
    be pushed down and compute it twice.
    """
    titles = F.filter(F.array(Ti.work_title("name", "volume")), lambda t: F.coalesce(t, F.lit("")) != "")
    return books.withColumn("work_title", F.explode(titles)).withColumn("work_key", F.upper("work_title"))


def group_works(books: DataFrame) -> DataFrame:
    """One row per work of ``books(work_key, work_title, id, genre, date_published, ord)``.

    Volumes are counted, dates compared as text, and name, genre and id taken from the first book.
    Everything is a decomposable aggregate, so a work with very many books is combined before the
    shuffle; creators and publishers stay in pair tables (``work_creators``, ``work_publishers``).
    """
    date = F.nullif("date_published", F.lit(""))
    first = F.min_by(F.struct("id", "genre", "work_title"), "ord")
    grouped = books.groupBy("work_key").agg(
        F.count("*").alias("total_volumes"), F.min(date).alias("first_published"), F.max(date).alias("last_published"),
        first.alias("f"), F.min("ord").alias("ord"),
    )
    return grouped.select(
        F.coalesce(F.nullif("f.id", F.lit("")), "work_key").alias("id"), "work_key", F.col("f.work_title").alias("title"),
        F.coalesce("f.genre", F.lit("")).alias("genre"), "total_volumes",
        F.coalesce("first_published", F.lit("")).alias("first_published"),
        F.coalesce("last_published", F.lit("")).alias("last_published"),
        (F.col("total_volumes") > 1).alias("is_series"), "ord",
    )


def work_creators(books: DataFrame) -> DataFrame:
    """(work_key, author_id) of books naming exactly one creator."""
    return books.filter("one_creator").select("work_key", F.explode("creator_ids").alias("author_id")).distinct()


def work_publishers(books: DataFrame) -> DataFrame:
    return books.select("work_key", F.explode("publishers").alias("publisher")).distinct()


def distinct_publishers(items: DataFrame) -> DataFrame:
    """Publisher names of books and magazines."""
    return items.filter(F.col("kind").isin("book", "magazine")).select(F.explode("publishers").alias("publisher")).distinct()


def author_names(items: DataFrame) -> DataFrame:
    """(author_id, name): names of books go to the one creator, names of series to the first one.

    Creators without a usable name appear once with a null name. Editorial departments are no names.
    """
    book = (F.col("kind") == "book") & F.col("one_creator")
    series = F.col("kind") == "series"
    rows = items.filter(book | series)
    # Ids and names come out of one pass: items are read, and parsed where they are derived, once.
    entry = lambda author_id, name, named: F.struct(author_id.alias("author_id"), name.alias("name"), F.lit(named).alias("named"))
    first = F.get("creator_ids", F.lit(0))
    ids = F.transform("creator_ids", lambda i: entry(i, F.lit(None).cast("string"), False))
    names = F.when(first.isNotNull(), F.transform(F.filter("creator_names", lambda n: ~N.is_editorial(n)), lambda n: entry(first, n, True)))
    none = F.array().cast("array<struct<author_id: string, name: string, named: boolean>>")
    entries = rows.select(F.explode(F.concat(F.coalesce(ids, none), F.coalesce(names, none))).alias("e"))
    found = entries.select("e.*").distinct()
    any_named = F.max("named").over(Window.partitionBy("author_id"))
    return found.withColumn("_any", any_named).filter(F.col("named") | ~F.col("_any")).select("author_id", "name")


def best_author_names(names: DataFrame) -> DataFrame:
    """One name per author: best script and role, then the lowest name."""
    ranked = F.struct((-N.role_aware_score("name")).alias("s"), F.col("name"))
    return names.groupBy("author_id").agg(
        F.min(F.when(F.col("name").isNotNull(), ranked)).alias("r")
    ).select("author_id", F.col("r.name").alias("name"))


def display_names(names: DataFrame, name: str, order: list[str], readings: DataFrame | None = None) -> DataFrame:
    """(key, name): per canonical key the name of the best script, the earliest among equals."""
    keyed = N.with_canonical_key(names, name, readings).filter(F.col("key").isNotNull())
    rank = F.struct((-N.script_priority(name)).alias("p"), *[F.col(o) for o in order], F.col(name))
    return keyed.groupBy("key").agg(F.min_by(name, rank).alias("name"))


def work_magazine_names(books: DataFrame, series: DataFrame, series_magazines: DataFrame, works: DataFrame) -> DataFrame:
    """(work_key, magazine): first-appearance notes of the books, and brands of the matching series.

    ``series(series_id, key)``, ``series_magazines(series_id, magazine)``.
    """
    noted = books.select("work_key", F.explode(N.first_appearance_magazines("description")).alias("magazine"))
    matched = match_series(series, works.select("work_key", "ord"))
    from_series = matched.join(series_magazines, "series_id")
    return noted.unionByName(from_series.select("work_key", "magazine")).distinct()


def series_rows(items: DataFrame) -> DataFrame:
    """Series items with an id, the first item of each id."""
    series = items.filter((F.col("kind") == "series") & (F.coalesce("id", F.lit("")) != ""))
    return first_per_key(series, ["id"], [F.col("ord")])


def series_brands(series: DataFrame, brands: DataFrame) -> DataFrame:
    """(series_id, magazine) of the brand field; brand names go through the lookup ``brands(key, value)``."""
    heads = series.select(F.col("id").alias("series_id"), F.explode("brands").alias("brand")).select(
        "series_id", N.brand_head("brand").alias("brand")
    )
    return N.translate_by(heads.filter(F.col("brand") != ""), "brand", brands, "magazine").select("series_id", "magazine").distinct()


def series_keys(series: DataFrame, magazines: DataFrame) -> DataFrame:
    """(series_id, key) of the named series that bring at least one magazine."""
    keyed = series.select(F.col("id").alias("series_id"), F.upper(F.get("names", F.lit(0))).alias("key"))
    return keyed.filter(F.coalesce("key", F.lit("")) != "").join(magazines.select("series_id").distinct(), "series_id", "left_semi")


def _edges(pairs: DataFrame, type_: str) -> DataFrame:
    distinct = pairs.select("src", "dst").distinct()
    return distinct.select(edge_id(F.col("src"), F.lit(type_), F.col("dst")).alias("id"), "src", "dst", F.lit(type_).alias("type"))


def build_graph(items: DataFrame, brands: DataFrame, readings: DataFrame | None = None) -> Graph:
    """The catalogue graph of typed items (see ``sources.jsonld.typed_items``).

    Items are read several times: store them first, as ``sources.jsonld.scan`` advises.
    """
    books = with_work_keys(items.filter("kind = 'book'").withColumn("name", F.get("names", F.lit(0))))
    works = group_works(books)

    best = best_author_names(author_names(items))
    keyed = N.with_canonical_key(best, "name", readings).withColumn("node_id", F.coalesce("key", "author_id"))
    shown = display_names(best.filter(F.col("name").isNotNull()), "name", ["author_id"], readings)
    authors = keyed.select("node_id", "key").distinct().join(shown, "key", "left")

    publisher_names = distinct_publishers(items)
    publishers = display_names(publisher_names, "publisher", [], readings)
    publisher_keys = N.with_canonical_key(publisher_names, "publisher", readings).filter(F.col("key").isNotNull())

    titled = items.filter("kind = 'magazine'").withColumn("title", F.get("names", F.lit(0)))
    magazines = N.with_canonical_key(titled.filter(F.coalesce("title", F.lit("")) != ""), "title", readings).filter(F.col("key").isNotNull())
    magazine_names = display_names(magazines.drop("key"), "title", ["ord"], readings)
    magazine_rows = magazines.groupBy("key").agg(F.max_by(F.struct("genre", "id"), "ord").alias("l")).join(magazine_names, "key")

    def node(type_: str, id_: Column, label: Column, *props) -> list[Column]:
        return [F.concat(F.lit(type_ + ":"), id_).alias("id"), F.lit(type_).alias("type"), label.alias("label"), *props]

    nodes = (
        works.select(*node("work", F.col("id"), F.col("title"), F.col("id").alias("work_id"), "title", "genre",
                           "total_volumes", "first_published", "last_published", "is_series"))
        .unionByName(authors.select(*node("author", F.col("node_id"), F.coalesce("name", "node_id"), "name",
                                          F.col("key").alias("normalized_id"))), allowMissingColumns=True)
        .unionByName(publishers.select(*node("publisher", F.col("key"), F.col("name"), "name")), allowMissingColumns=True)
        .unionByName(magazine_rows.select(*node("magazine", F.col("key"), F.col("name"), F.col("name").alias("title"),
                                                F.col("l.genre").alias("genre"), F.col("l.id").alias("original_id"))),
                     allowMissingColumns=True)
    )

    ids = works.select("work_key", F.concat(F.lit("work:"), "id").alias("src"))
    author_map = keyed.select("author_id", F.concat(F.lit("author:"), "node_id").alias("dst"))
    created = work_creators(books).join(author_map, "author_id").join(ids, "work_key")
    magazine_map = magazines.select(F.col("title").alias("magazine"), F.concat(F.lit("magazine:"), "key").alias("dst")).distinct()
    series = series_rows(items)
    branded = series_brands(series, brands)
    names = work_magazine_names(books, series_keys(series, branded), branded, works)
    in_magazine = names.join(magazine_map, "magazine").join(ids, "work_key")
    by_publisher = first_publisher_links(magazines, publisher_keys)
    edges = _edges(created, CREATED_BY).unionByName(_edges(in_magazine, PUBLISHED_IN)).unionByName(_edges(by_publisher, PUBLISHED_BY))
    return Graph(nodes, edges)


def first_publisher_links(magazines: DataFrame, publisher_keys: DataFrame) -> DataFrame:
    """(src, dst) from each magazine to its first usable publisher.

    ``magazines(key, publishers)``, ``publisher_keys(publisher, key)``.
    """
    firsts = magazines.select(
        F.concat(F.lit("magazine:"), "key").alias("src"), F.get("publishers", F.lit(0)).alias("publisher")
    ).filter(F.col("publisher").isNotNull()).distinct()
    known = publisher_keys.select("publisher", F.concat(F.lit("publisher:"), "key").alias("dst"))
    return firsts.join(known, "publisher").select("src", "dst").distinct()


def inverted_index(rows: DataFrame, id_: str, names: str, out: str = "name") -> DataFrame:
    """(name, id) of a list column, each pair once."""
    return rows.select(F.explode(names).alias(out), id_).filter(F.coalesce(out, F.lit("")) != "").distinct()


def related_edges(works: DataFrame) -> DataFrame:
    """RELATED_TO edges of the related lists between works that exist; the last relation per pair wins.

    ``works(id, related_manga, related_anime)``; anime ids carry their prefix.
    """
    def side(column: str, prefix: str, part: int) -> DataFrame:
        rows = works.select(F.col("id").alias("src"), F.posexplode(column).alias("i", "r"))
        return rows.filter(F.col("r.id").isNotNull()).select(
            "src", F.concat(F.lit(prefix), F.col("r.id").cast("string")).alias("dst"),
            F.coalesce("r.relation_type", F.lit("related")).alias("relation_type"),
            F.struct(F.lit(part).alias("part"), F.col("i")).alias("ord"))

    pairs = side("related_manga", "", 0).unionByName(side("related_anime", "anime_", 1))
    last = pairs.groupBy("src", "dst").agg(F.max_by("relation_type", "ord").alias("relation_type"))
    known = works.select(F.col("id").alias("dst")).distinct()
    return last.join(known, "dst", "left_semi").select(
        edge_id(F.col("src"), F.lit(RELATED_TO), F.col("dst")).alias("id"), "src", "dst", F.lit(RELATED_TO).alias("type"), "relation_type"
    )


def media_edges(works: DataFrame) -> DataFrame:
    """Edges of work rows: authors and magazines for manga, studios for anime (by id prefix)."""
    anime = F.col("id").startswith("anime_")

    def pairs(rows: DataFrame, column: str, node_type: str) -> DataFrame:
        return inverted_index(rows, "id", column).select(
            F.col("id").alias("src"), F.concat(F.lit(node_type + ":"), "name").alias("dst")
        )

    manga = works.filter(~anime)
    return (
        _edges(pairs(manga, "authors", "author"), CREATED_BY)
        .unionByName(_edges(pairs(manga, "serialization", "magazine"), PUBLISHED_IN))
        .unionByName(_edges(pairs(works.filter(anime), "studios", "studio"), PRODUCED_BY))
    )


def media_nodes(works: DataFrame) -> DataFrame:
    """(id, type, label, name) of the authors, magazines and studios that ``media_edges`` leads to."""
    anime = F.col("id").startswith("anime_")

    def named(rows: DataFrame, column: str, node_type: str) -> DataFrame:
        names = rows.select(F.explode(column).alias("name")).filter(F.coalesce("name", F.lit("")) != "").distinct()
        return names.select(F.concat(F.lit(node_type + ":"), "name").alias("id"), F.lit(node_type).alias("type"), F.col("name").alias("label"), "name")

    manga = works.filter(~anime)
    return named(manga, "authors", "author").unionByName(named(manga, "serialization", "magazine")).unionByName(
        named(works.filter(anime), "studios", "studio"))


def details_authors(details: DataFrame) -> DataFrame:
    """Author nodes of ``details(mal_id, authors)``, one per name with the fields of its entry with the greatest ``mal_id``.

    They are meant for ``insert_missing``: an author already stored keeps its fields.
    """
    entries = details.select("mal_id", F.posexplode("authors").alias("pos", "a"))
    last = entries.groupBy(F.col("a.name").alias("name")).agg(F.max_by("a", F.struct("mal_id", "pos")).alias("a"))
    return last.select(F.concat(F.lit("author:"), "name").alias("id"), F.lit("author").alias("type"), F.col("name").alias("label"), "name",
                       F.col("a.id").alias("mal_id"), "a.first_name", "a.last_name")


def details_edges(details: DataFrame, works: DataFrame) -> DataFrame:
    """CREATED_BY edges with ``role`` from works of the same ``mal_id`` to the named authors; the first role of a pair stays."""
    entries = details.select("mal_id", F.posexplode("authors").alias("pos", "a"))
    found = entries.join(works.select("mal_id", F.col("id").alias("src")), "mal_id")
    pairs = found.groupBy("src", F.concat(F.lit("author:"), "a.name").alias("dst")).agg(F.min_by("a.role", "pos").alias("role"))
    return pairs.select(edge_id(F.col("src"), F.lit(CREATED_BY), F.col("dst")).alias("id"), "src", "dst", F.lit(CREATED_BY).alias("type"), "role")


# Volumes ---------------------------------------------------------------------------------------

VOLUME_THRESHOLD = 2


def volume_groups(works: DataFrame) -> DataFrame:
    """Per base title: distinct positive volume numbers, else works, and at least 1.

    ``works(id, title, volume, ...)``. Two aggregate levels instead of one set per title.
    """
    rows = works.select(Ti.base_title("title").alias("base"), Ti.volume_number("title", "volume").alias("v"))
    positive = F.when(F.col("v") > 0, F.col("v"))
    per_number = rows.groupBy("base", positive.alias("v")).agg(F.count("*").alias("n"))
    grouped = per_number.groupBy("base").agg(F.count("v").alias("volumes"), F.sum("n").alias("works"))
    counted = F.when(F.col("volumes") > 0, F.col("volumes")).otherwise(F.col("works"))
    return grouped.select("base", "works", F.greatest(counted, F.lit(1)).cast("int").alias("target"))


def volume_updates(works: DataFrame, threshold: int = VOLUME_THRESHOLD) -> DataFrame:
    """(id, total_volumes) for works whose count is missing or below the threshold."""
    low = works.filter(F.col("total_volumes").isNull() | (F.col("total_volumes") < threshold))
    keyed = low.select("id", Ti.base_title("title").alias("base"))
    groups = volume_groups(works).select("base", F.col("target").alias("total_volumes"))
    return keyed.join(groups, keyed["base"].eqNullSafe(groups["base"])).select("id", "total_volumes")


def volume_stats(works: DataFrame, threshold: int = VOLUME_THRESHOLD) -> DataFrame:
    """Groups, groups with something to update, and updates."""
    low = F.col("total_volumes").isNull() | (F.col("total_volumes") < threshold)
    per = works.groupBy(Ti.base_title("title").alias("base")).agg(F.count_if(low).alias("low"))
    return per.agg(
        F.count("*").alias("total_groups"), F.count_if(F.col("low") > 0).alias("candidate_groups"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("updates"),
    )
