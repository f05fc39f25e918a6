"""Related works: subgraphs, ranked magazine lists, overlapping periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.functions.scoring import (
    demographic_score, end_year, overlap_years, period_gap, period_jaccard, start_year, themes_overlap, themes_ratio,
)
from shelfgraph.functions.text import col
from shelfgraph.graph import CREATED_BY, PUBLISHED_BY, PUBLISHED_IN, Graph, empty_like
from shelfgraph.operators.expand import expand, linked, sources_of
from shelfgraph.operators.filters import min_volumes
from shelfgraph.operators.limits import top_per_key, top_rows
from shelfgraph.operators.search import TITLES, by_title
from shelfgraph.session import spread

YEAR_BUCKET = 5
DEALS = 16  # shares of the works that meet the anchors of a publisher apart
SCORES = ["demo_score", "themes_score", "themes_ratio", "date_jaccard"]


def work_by_id(works: DataFrame, node_id: str) -> DataFrame:
    return works.filter(F.col("id") == node_id)


def work_subgraph(graph: Graph, node_id: str) -> Graph:
    """One work and everything one hop away."""
    return expand(graph, work_by_id(graph.of_type("work"), node_id), with_publishers=False, known_id=node_id)


def _star(graph: Graph, rows: DataFrame, edge_type: str, centre_id: str, centre_type: str) -> Graph:
    rows = rows.persist()
    centre = graph.of_type(centre_type).filter(F.col("id") == centre_id)
    edges = linked(graph, edge_type, centre_id).join(rows.select(F.col("id").alias("src")), "src", "left_semi")
    # A missing or childless centre gives an empty graph.
    kept = centre.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    return Graph(rows.unionByName(kept, allowMissingColumns=True), edges, held=(rows,))


def author_works(graph: Graph, author_id: str, limit: int = 50) -> Graph:
    # First the ids, out of titles alone (``distinct`` lets Spark leave out what else works are joined with), then the rows of these works.
    titled = sources_of(graph, CREATED_BY, author_id, "work").select("id", *TITLES).distinct()
    works = graph.few_nodes(top_rows(titled, limit, *by_title()).select("id")).filter(F.col("type") == "work")
    hits = top_rows(works, limit, *by_title())
    return _star(graph, hits, CREATED_BY, author_id, "author")


def with_reference_scores(works: DataFrame, reference: DataFrame, as_of_year: int) -> DataFrame:
    """Score columns of every work against the single row of ``reference``.

    The reference row comes in as a scalar subquery, so the works are not joined at all. Without a
    reference row there is no result.
    """
    ref = F.struct(
        F.coalesce("demographic", F.array().cast("array<string>")).alias("demographic"),
        F.coalesce("themes", F.array().cast("array<string>")).alias("themes"),
        start_year("publishing_date").alias("first"),
        end_year("publishing_date", as_of_year).alias("last"),
    )
    first, last = start_year("publishing_date"), end_year("publishing_date", as_of_year)
    return (
        works.withColumn("_ref", reference.select(ref).scalar()).filter(F.col("_ref").isNotNull())
        .withColumn("demo_score", demographic_score("_ref.demographic", "demographic"))
        .withColumn("themes_score", themes_overlap("_ref.themes", "themes"))
        .withColumn("themes_ratio", themes_ratio("_ref.themes", "themes"))
        .withColumn("date_jaccard", period_jaccard("_ref.first", "_ref.last", first, last))
        .drop("_ref")
    )


def by_reference() -> list[Column]:
    """Audience, themes, share of themes, period; then title. Unknown scores come first, as stored."""
    return [*[F.col(c).desc_nulls_first() for c in SCORES], *by_title()]


def magazine_works(graph: Graph, magazine_id: str, limit: int = 50, reference_id: str | None = None,
                   as_of_year: int | None = None) -> Graph:
    """Works of a magazine by title, or by likeness to a reference work, which is left out."""
    works = sources_of(graph, PUBLISHED_IN, magazine_id, "work")
    if reference_id is None:
        hits = top_rows(works, limit, *by_title())
    else:
        if as_of_year is None:
            raise ValueError("as_of_year is needed with a reference work")
        reference = work_by_id(graph.of_type("work"), reference_id)
        scored = with_reference_scores(works.filter(F.col("id") != reference_id), reference, as_of_year)
        hits = top_rows(scored, limit, *by_reference())
    return _star(graph, hits, PUBLISHED_IN, magazine_id, "magazine")


def publisher_magazines(graph: Graph, publisher_id: str, limit: int = 50, exclude_id: str | None = None) -> Graph:
    magazines = sources_of(graph, PUBLISHED_BY, publisher_id, "magazine")
    if exclude_id is not None:
        magazines = magazines.filter(F.col("id") != exclude_id)
    hits = top_rows(magazines, limit, F.lower(F.coalesce("name", F.lit(""))), F.col("id"))
    return _star(graph, hits, PUBLISHED_BY, publisher_id, "publisher")


def works_per_magazine(graph: Graph, magazine_ids: list[str] | None, work_limit: int,
                       reference_id: str | None = None, as_of_year: int | None = None) -> DataFrame:
    """The best ``work_limit`` works of each magazine, one row per (magazine, work).

    Only the sort keys travel to the per-magazine ranking. ``None`` means every magazine.
    """
    in_magazine = linked(graph, PUBLISHED_IN)
    if magazine_ids is not None:
        in_magazine = in_magazine.filter(F.col("dst").isin(magazine_ids))
    works = graph.of_type("work")
    title_key = F.lower(F.coalesce("title_name", "english_name", "title", "work_id", F.lit("")))
    if reference_id is None:
        keyed = works.select("id", title_key.alias("_title"))
        order = []
    else:
        if as_of_year is None:
            raise ValueError("as_of_year is needed with a reference work")
        reference = work_by_id(works, reference_id)
        others = works.filter(F.col("id") != reference_id)
        keyed = with_reference_scores(others, reference, as_of_year).select("id", *SCORES, title_key.alias("_title"))
        order = [F.col(c).desc_nulls_first() for c in SCORES]
    pairs = in_magazine.select(F.col("dst").alias("magazine_id"), F.col("src").alias("id"),
                               F.col("id").alias("edge_id")).join(keyed, "id")
    return top_per_key(pairs, ["magazine_id"], [*order, F.col("_title"), F.col("id")], work_limit).drop("_title")


def magazines_work_graph(graph: Graph, magazine_ids: list[str], work_limit: int = 50,
                         reference_id: str | None = None, as_of_year: int | None = None) -> Graph:
    """Works of several magazines, ``work_limit`` each; magazines without works stay as nodes."""
    if not magazine_ids:
        return empty_like(graph)
    best = works_per_magazine(graph, magazine_ids, work_limit, reference_id, as_of_year)
    works = graph.of_type("work").join(best.select("id").distinct(), "id", "left_semi")
    magazines = graph.of_type("magazine").filter(F.col("id").isin(magazine_ids))
    if reference_id is not None:
        # No reference work, no result at all.
        known = work_by_id(graph.of_type("work"), reference_id).select(F.lit(True)).scalar()
        magazines = magazines.withColumn("_known", known).filter("_known").drop("_known")
    edges = linked(graph, PUBLISHED_IN).join(best.select(F.col("edge_id").alias("id")), "id", "left_semi")
    return Graph(works.unionByName(magazines), edges)


def related_graphs(graph: Graph, author_id: str | None = None, magazine_id: str | None = None,
                   publisher_id: str | None = None, author_limit: int = 5, magazine_limit: int = 5,
                   publisher_limit: int = 3, reference_id: str | None = None, exclude_magazine_id: str | None = None,
                   as_of_year: int | None = None) -> dict[str, Graph | None]:
    """Author, magazine and publisher graphs of one request; a part not asked for is None."""
    return {
        "author_graph": author_works(graph, author_id, author_limit) if author_id else None,
        "magazine_graph": magazine_works(graph, magazine_id, magazine_limit, reference_id, as_of_year)
        if magazine_id else None,
        "publisher_graph": publisher_magazines(graph, publisher_id, publisher_limit, exclude_magazine_id)
        if publisher_id else None,
    }


def tag_parts(parts: dict[str, Graph | None]) -> tuple[DataFrame, DataFrame]:
    """The requested parts as one node and one edge table with a ``part`` column."""
    asked = {k: g for k, g in parts.items() if g is not None}
    join = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return (
        join([g.nodes.withColumn("part", F.lit(k)) for k, g in asked.items()]),
        join([g.edges.withColumn("part", F.lit(k)) for k, g in asked.items()]),
    )


def _period(works: DataFrame) -> DataFrame:
    return works.filter(F.col("first_year").isNotNull() & F.col("last_year").isNotNull())


def same_publisher_other_magazines(graph: Graph, anchor_id: str, year_window: int = 2, limit: int | None = None) -> DataFrame:
    """Works in other magazines of the anchor's publishers, active within the window of its period.

    The anchor's years are scalar values, so the period test is a filter on the works; only the
    publisher link needs joins. Works of an anchor author are flagged and come last.
    """
    works = _period(graph.of_type("work"))
    anchor = work_by_id(works, anchor_id).select(F.struct("first_year", "last_year")).scalar()
    near = (
        works.filter(F.col("id") != anchor_id).withColumn("_a", anchor)
        .filter((F.col("last_year") >= F.col("_a.first_year") - year_window)
                & (F.col("first_year") <= F.col("_a.last_year") + year_window))
    )
    own_magazines = linked(graph, PUBLISHED_IN).filter(F.col("src") == anchor_id).select(F.col("dst").alias("magazine_id"))
    by = linked(graph, PUBLISHED_BY).select(F.col("src").alias("magazine_id"), F.col("dst").alias("publisher_id"))
    publishers = by.join(own_magazines, "magazine_id", "left_semi").select("publisher_id").distinct()
    magazines = by.join(publishers, "publisher_id", "left_semi").join(own_magazines, "magazine_id", "left_anti")
    placed = (
        linked(graph, PUBLISHED_IN).select(F.col("src").alias("id"), F.col("dst").alias("magazine_id"))
        .join(magazines, "magazine_id").groupBy("id").agg(F.min(F.struct("magazine_id", "publisher_id")).alias("_m"))
    )
    authors = linked(graph, CREATED_BY).filter(F.col("src") == anchor_id).select("dst")
    same_author = (
        linked(graph, CREATED_BY).join(authors, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        .withColumn("_same", F.lit(True))
    )
    a0, a1 = F.col("_a.first_year"), F.col("_a.last_year")
    rows = (
        near.join(placed, "id").join(same_author, "id", "left")
        .withColumn("overlap_years", overlap_years(a0, a1, "first_year", "last_year"))
        .withColumn("period_gap", period_gap(a0, a1, "first_year", "last_year"))
        .withColumn("jaccard_similarity", period_jaccard(a0, a1, "first_year", "last_year"))
        .withColumn("same_author", F.coalesce("_same", F.lit(False)))
        .withColumn("magazine_id", F.col("_m.magazine_id")).withColumn("publisher_id", F.col("_m.publisher_id"))
        .drop("_a", "_m", "_same")
    )
    if limit is None:
        return rows
    return top_rows(rows, limit, F.col("same_author"), F.col("jaccard_similarity").desc(),
                    F.col("overlap_years").desc(), F.col("period_gap"), F.col("id"))


def _year_buckets(first, last, window: int = 0) -> Column:
    """The buckets of ``YEAR_BUCKET`` years that a period, widened by ``window`` years on both sides, reaches."""
    number = lambda year: F.floor((col(year) + 100_000) / YEAR_BUCKET).cast("int")  # a bucket starts at a multiple, before Christ too
    return F.sequence(number(F.expr(f"{first} - {window}")), number(F.expr(f"{last} + {window}")))


def _met(anchors: DataFrame, works: DataFrame, window: int, a_more: tuple[str, ...] = (), b_more: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides, ``a_`` and ``b_``, whose periods overlap or lie at most ``window`` years apart and that are equal in ``on``.

    An equality join on year buckets: periods that meet share a bucket, and two rows meet in the first one they share only. With ``on``, both
    sides are dealt out by the keys: few bytes make many pairs, so their size must not decide the number of tasks.
    """
    side = lambda df, p, w, more: df.filter(F.col("first_year") <= F.col("last_year")).select(
        F.col("first_year").alias(f"{p}first"), F.col("last_year").alias(f"{p}last"), F.explode(_year_buckets("first_year", "last_year", w)).alias(f"{p}bucket"),
        *[F.col(c).alias(f"{p}{c}") for c in (*more, *on)])
    a, b = side(anchors, "a_", window, a_more), side(works, "b_", 0, b_more)
    if on:
        a, b = spread(a, "a_bucket", *[f"a_{c}" for c in on]), spread(b, "b_bucket", *[f"b_{c}" for c in on])
    keys = reduce(Column.__and__, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("bucket", *on)])
    first_shared = F.floor((F.greatest(F.col("a_first") - window, F.col("b_first")) + 100_000) / YEAR_BUCKET)
    return a.join(b, keys).filter((F.col("a_bucket") == first_shared) & (F.col("b_last") >= F.col("a_first") - window) & (F.col("b_first") <= F.col("a_last") + window))


def period_pairs(anchors: DataFrame, works: DataFrame, window: int = 0) -> DataFrame:
    """(anchor_id, id) of all pairs whose periods overlap or lie at most ``window`` years apart, each once.

    Both sides have ``id``, ``first_year`` and ``last_year``; periods that end before they begin meet nothing.
    """
    met = _met(anchors, works, window, ("id",), ("id",)).filter(F.col("a_id") != F.col("b_id"))
    return met.select(F.col("a_id").alias("anchor_id"), F.col("b_id").alias("id"))


def _with_periods(pairs: DataFrame, works: DataFrame) -> DataFrame:
    own = works.select(F.col("id").alias("anchor_id"), F.col("first_year").alias("_first"), F.col("last_year").alias("_last"))
    rows = pairs.join(own, "anchor_id").join(works.select("id", "first_year", "last_year"), "id")
    a = (F.col("_first"), F.col("_last"), "first_year", "last_year")
    return rows.withColumns({"overlap_years": overlap_years(*a), "period_gap": period_gap(*a), "jaccard_similarity": period_jaccard(*a)}).drop("_first", "_last")


def _linked_lists(graph: Graph) -> DataFrame:
    """(id, places, magazines, publishers, authors) of the works that are in a magazine with a publisher; ``places`` lists (magazine_id, publisher_id) in order."""
    by = linked(graph, PUBLISHED_BY).select(F.col("src").alias("magazine_id"), F.col("dst").alias("publisher_id")).distinct()
    placed = linked(graph, PUBLISHED_IN).select(F.col("src").alias("id"), F.col("dst").alias("magazine_id")).distinct().join(by, "magazine_id")
    lists = placed.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("magazine_id", "publisher_id"))).alias("places"),
                                     F.array_sort(F.collect_set("magazine_id")).alias("magazines"), F.collect_set("publisher_id").alias("publishers"))
    made = linked(graph, CREATED_BY).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("authors"))
    return lists.join(made, "id", "left")


def same_publisher_pairs(graph: Graph, anchors: DataFrame, year_window: int = 2, k: int | None = None) -> DataFrame:
    """``same_publisher_other_magazines`` for a table of anchors ``(id)``: (anchor_id, id, magazine_id, publisher_id, scores), the ``k`` best of each if asked.

    Candidates share a publisher through another magazine and lie within the window. They meet in an equality join on publisher and year bucket,
    which is dealt out over ``DEALS`` shares of the works. A pair counts at the first publisher it shares, and all else is told from the lists
    of the two works, so no pair is shuffled.
    """
    works = _period(graph.of_type("work")).select("id", "first_year", "last_year").join(_linked_lists(graph), "id")
    works = works.withColumn("publisher", F.explode("publishers")).withColumn("before", F.filter("publishers", lambda p: p < F.col("publisher")))
    own = works.join(anchors.select("id").distinct(), "id", "left_semi").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = works.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)).cast("int"))
    met = _met(own, dealt, year_window, ("id", "magazines", "publishers", "authors", "before"),
               ("id", "places", "magazines", "publishers", "authors", "before"), ("publisher", "deal"))
    pairs = met.filter((F.col("a_id") != F.col("b_id")) & ~F.arrays_overlap("a_before", "b_before"))
    # The magazine that counts: the smallest of the candidate's at a publisher of the anchor's that is none of the anchor's magazines.
    # An array of one is exploded so that it is worked out once, after all other tests.
    others = F.array_except("b_magazines", "a_magazines")
    shared = lambda m: F.exists("b_places", lambda p: (p["magazine_id"] == m) & F.array_contains("a_publishers", p["publisher_id"]))
    first = F.when(F.size(F.array_except("b_publishers", "a_publishers")) == 0, F.get(others, F.lit(0))).otherwise(F.get(F.filter(others, shared), F.lit(0)))
    found = pairs.withColumn("magazine_id", F.explode_outer(F.array(first))).filter("magazine_id is not null")
    publisher = F.array_min(F.transform(F.filter("b_places", lambda p: (p["magazine_id"] == F.col("magazine_id")) & F.array_contains("a_publishers", p["publisher_id"])),
                                        lambda p: p["publisher_id"]))
    years = ("a_first", "a_last", "b_first", "b_last")
    rows = found.select(
        F.col("a_id").alias("anchor_id"), F.col("b_id").alias("id"), "magazine_id", publisher.alias("publisher_id"), overlap_years(*years).alias("overlap_years"), period_gap(*years).alias("period_gap"),
        period_jaccard(*years).alias("jaccard_similarity"), F.coalesce(F.arrays_overlap("a_authors", "b_authors"), F.lit(False)).alias("same_author"))
    order = [F.col("same_author"), F.col("jaccard_similarity").desc(), F.col("overlap_years").desc(), F.col("period_gap"), F.col("id")]
    return rows if k is None else top_per_key(rows, ["anchor_id"], order, k)


def overlap_period_pairs(works: DataFrame, anchors: DataFrame, k: int | None = None) -> DataFrame:
    """``overlap_period_works`` for a table of anchors ``(id)``: (anchor_id, id, overlap_years), the ``k`` with the most years for each if asked.

    For the ``k`` best, periods meet and not works: the years that two works share depend on their periods only, so of the works
    of one period the first ``k + 1`` by id can be among the best of an anchor (itself may be one of them).
    """
    known = _period(works).select("id", "first_year", "last_year")
    own = known.join(anchors.select("id").distinct(), "id", "left_semi")
    pairs = period_pairs(own, known) if k is None else _first_of_periods(own, known, k)
    rows = _with_periods(pairs, known).filter(F.col("overlap_years") > 0)
    rows = rows.select("anchor_id", "id", "overlap_years")
    return rows if k is None else top_per_key(rows, ["anchor_id"], [F.col("overlap_years").desc(), F.col("id")], k)


def _first_of_periods(anchors: DataFrame, works: DataFrame, k: int) -> DataFrame:
    """(anchor_id, id) of the ``k`` works, and their copies, that share the most years with each anchor."""
    first_ids = lambda rows, keys, *order: rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k + 1).drop("_r")
    firsts = first_ids(works, ["first_year", "last_year"], F.col("id"))
    periods = anchors.select("first_year", "last_year").distinct()
    met = _met(periods, firsts, 0, (), ("id",)).withColumn("_n", overlap_years("a_first", "a_last", "b_first", "b_last"))
    best = first_ids(met, ["a_first", "a_last"], F.col("_n").desc(), F.col("b_id")).select(F.col("a_first").alias("first_year"), F.col("a_last").alias("last_year"), "b_id")
    pairs = anchors.join(best, ["first_year", "last_year"]).filter(F.col("id") != F.col("b_id"))
    return pairs.select(F.col("id").alias("anchor_id"), F.col("b_id").alias("id"))


def overlap_period_works(graph: Graph, anchor_id: str, limit: int = 15) -> DataFrame:
    """Works sharing the most years with the anchor."""
    works = _period(graph.of_type("work"))
    anchor = work_by_id(works, anchor_id).select(F.struct("first_year", "last_year")).scalar()
    shared = overlap_years("_a.first_year", "_a.last_year", "first_year", "last_year")
    rows = (
        works.filter(F.col("id") != anchor_id).withColumn("_a", anchor).withColumn("overlap_years", shared)
        .filter(F.col("overlap_years") > 0).drop("_a")
    )
    return top_rows(rows, limit, F.col("overlap_years").desc(), F.col("id"))


def by_volumes(descending: bool) -> list[Column]:
    """Works by volumes (else counted works), then all other nodes."""
    volumes = F.coalesce(F.nullif("total_volumes", F.lit(0)), F.col("members"), F.lit(0))
    return [
        (F.col("type") != "work").asc(),
        (volumes.desc() if descending else volumes.asc()),
        F.col("id").asc(),
    ]


def search_with_same_publisher(hits: DataFrame, graph: Graph, anchor_id: str, year_window: int = 2, related_limit: int | None = None,
                               include_related: bool = True, min_total_volumes: int | None = None, sort_total_volumes: str | None = None) -> DataFrame:
    """Main hits (node rows) with works of the anchor's publishers in other magazines, as one list; a main hit is not repeated.

    ``min_total_volumes`` keeps long series only; ``sort_total_volumes`` (asc or desc) orders by volumes, else main hits come first.
    """
    if sort_total_volumes not in (None, "asc", "desc"):
        raise ValueError("sort_total_volumes must be asc or desc")
    rows = hits.withColumn("_part", F.lit(0))
    if include_related:
        others = same_publisher_other_magazines(graph, anchor_id, year_window, related_limit)
        fresh = others.join(hits.select("id"), "id", "left_anti").withColumn("_part", F.lit(1))
        rows = rows.unionByName(fresh, allowMissingColumns=True)
    if min_total_volumes is not None:
        rows = min_volumes(rows, min_total_volumes)
    order = by_volumes(sort_total_volumes == "desc") if sort_total_volumes else [F.col("_part"), *by_title()]
    return rows.orderBy(*order).drop("_part")
