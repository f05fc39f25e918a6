"""Embedding similarity: exact cosine k-NN, multi-column, hybrid, and embedding maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.functions.names import entity_id
from shelfgraph.functions.text import col
from shelfgraph.functions.vectors import cosine, cosine_to, embedding_text, fit, hash_embedding, unit_score
from shelfgraph.graph import CREATED_BY, Graph, edge_id
from shelfgraph.operators.expand import expand
from shelfgraph.operators.filters import without_genre
from shelfgraph.operators.limits import first_per_key, top_rows
from shelfgraph.operators.upsert import update_existing
from shelfgraph.operators.vector_cells import VectorCells

# Named embedding columns a search may use (fixed values).
EMBEDDINGS = ("embedding_title_en", "embedding_title_ja", "embedding_description")
EXCLUDED_GENRE = "Hentai"
# Hybrid scores (fixed values).
TEXT_SCORE = 0.7
BOTH_BONUS = 0.1


def _check(column: str) -> str:
    if column not in EMBEDDINGS:
        raise ValueError("Unsupported embedding property")
    return column


def scored(works: DataFrame, query: Column | list[float], column: str, unit: bool = False) -> DataFrame:
    """Rows having the embedding, with ``similarity_score``: one scan of ids and vectors, no shuffle."""
    similarity = cosine_to(column, query) if isinstance(query, list) else cosine(column, query)
    return (
        works.filter(F.col(column).isNotNull())
        .withColumn("similarity_score", unit_score(similarity) if unit else similarity)
        .filter(F.col("similarity_score").isNotNull())
    )


def by_similarity() -> list[Column]:
    return [F.round("similarity_score", 9).desc(), F.col("id").asc()]


def nearest(vectors: DataFrame | VectorCells, works: DataFrame, query, column: str, limit: int, threshold: float | None = None,
            exclude_genre: str | None = EXCLUDED_GENRE) -> DataFrame:
    """The ``limit`` most similar works, from ``vectors(id, <columns>)``, or an index of them, and node rows.

    Vectors are only scanned: ids and scores go on, ids of works that may not appear leave, the limit is taken, and the works of these few
    rows are fetched. A threshold drops rows from the end of the list, so it can wait until after the limit.
    """
    eligible = without_genre(works, exclude_genre) if exclude_genre else works
    if isinstance(vectors, VectorCells):
        if vectors.column != column:
            raise ValueError(f"the index is of {vectors.column}")
        vectors = vectors.near(query, limit, eligible)
    hits = scored(vectors.select("id", column), query, column).drop(column)
    best = top_rows(hits.join(eligible.select("id"), "id", "left_semi"), limit, *by_similarity())
    if threshold is not None:
        best = best.filter(F.col("similarity_score") >= threshold)
    return top_rows(works.join(best, "id"), limit, *by_similarity())


def similar_works(vectors: DataFrame | VectorCells, works: DataFrame, query, column: str, limit: int = 5, threshold: float = 0.5,
                  exclude_genre: str | None = EXCLUDED_GENRE) -> DataFrame:
    """The result list of a similarity search."""
    return nearest(vectors, works, query, _check(column), limit, threshold, exclude_genre).select(
        "id", "work_id", F.coalesce("title_name", "title", "english_name").alias("title_en"),
        F.col("japanese_name").alias("title_ja"), "similarity_score", "media_type", "genres",
    )


def similar_works_multi(vectors: DataFrame, works: DataFrame, query, columns: list[str], limit: int = 10, threshold: float = 0.3,
                        exclude_genre: str | None = EXCLUDED_GENRE) -> DataFrame:
    """Best score of each work over several embedding columns; unknown columns are skipped.

    ``query`` is one vector, or a dict of one for each column.
    """
    known = [c for c in columns if c in EMBEDDINGS]
    if not known:
        raise ValueError("no supported embedding property")
    lists = [
        similar_works(vectors, works, query[c] if isinstance(query, dict) else query, c, limit, threshold, exclude_genre).withColumn("_prio", F.lit(i))
        for i, c in enumerate(known)
    ]
    merged = reduce(lambda a, b: a.unionByName(b), lists)
    best = first_per_key(merged, ["id"], [F.round("similarity_score", 9).desc(), F.col("_prio")]).drop("_prio")
    return top_rows(best, limit, *by_similarity())


def similar_graph(graph: Graph, vectors: DataFrame | VectorCells, query, column: str, limit: int = 20) -> Graph:
    """Similar works as seeds of a neighbourhood."""
    return expand(graph, nearest(vectors, graph.of_type("work"), query, _check(column), limit, exclude_genre=None))


def nearest_to_work(works: DataFrame, node_id: str, column: str, limit: int, cells: VectorCells | None = None) -> DataFrame:
    """Works nearest to a stored work, which stays in the list. Its vector comes as a scalar subquery.

    With an index of the works' vectors the vector is fetched first, and the scores come from the cells that can hold the nearest.
    """
    if cells is not None:
        own = works.filter(F.col("id") == node_id).select(F.col(column)).first()
        query = [float(x) for x in own[0]] if own and own[0] else [0.0] * cells.cells[1].shape[1]
        best = top_rows(scored(cells.near(query, limit, works), query, column).drop(column).join(works.select("id"), "id", "left_semi"), limit, *by_similarity())
        return top_rows(works.join(best, "id"), limit, *by_similarity())
    own = works.filter(F.col("id") == node_id).select(F.col(column)).scalar()
    with_query = works.withColumn("_q", own)
    return top_rows(scored(with_query, F.col("_q"), column).drop("_q"), limit, *by_similarity())


def similar_titles(vectors: DataFrame | VectorCells, works: DataFrame, query, column: str, limit: int = 5, threshold: float = 0.8) -> DataFrame:
    hits = nearest(vectors, works, query, column, limit, threshold, exclude_genre=None)
    return hits.select(F.coalesce("title_name", "title", "english_name").alias("title"), "similarity_score")


def hits_with_creators(hits: DataFrame, credits: DataFrame) -> Graph:
    """Vector hits as work nodes with an author node and edge per creator."""
    made = (
        credits.filter(F.col("kind") == "creator").join(hits.select(F.col("id").alias("work_id")), "work_id", "left_semi")
        .withColumn("author_id", F.concat(F.lit("author_"), F.col("name")))
    )
    authors = made.select(F.col("author_id").alias("id"), F.lit("author").alias("type"), F.col("name").alias("label")).distinct()
    edges = made.select(
        edge_id(F.col("work_id"), F.lit(CREATED_BY), F.col("author_id")).alias("id"), F.col("work_id").alias("src"),
        F.col("author_id").alias("dst"), F.lit(CREATED_BY).alias("type"),
    ).distinct()
    return Graph(hits.unionByName(authors, allowMissingColumns=True), edges)


def hybrid(text_hits: DataFrame | None, vector_hits: DataFrame | None, limit: int) -> DataFrame:
    """Half the limit from each side, one row per work, with a bonus for works on both sides.

    ``text_hits(id, ...)`` and ``vector_hits(id, similarity_score, ...)`` arrive in their own order,
    already cut to ``limit // 2``. With one side only, that side is the result.
    """
    if text_hits is None and vector_hits is None:
        raise ValueError("a term or a vector is needed")
    if vector_hits is None:
        both = text_hits.select("id", F.lit(TEXT_SCORE).alias("search_score"))
    elif text_hits is None:
        both = vector_hits.select("id", F.col("similarity_score").alias("search_score"))
    else:
        t = text_hits.select("id", F.lit(True).alias("_text"))
        v = vector_hits.select("id", F.col("similarity_score").alias("_sim"))
        both = t.join(v, "id", "full").select(
            "id",
            F.when(F.col("_sim").isNull(), F.lit(TEXT_SCORE)).when(F.col("_text").isNull(), F.col("_sim"))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(TEXT_SCORE), "_sim") + BOTH_BONUS)).alias("search_score"),
        )
    return top_rows(both, limit, F.round("search_score", 9).desc(), F.col("id"))


# Embedding maintenance ------------------------------------------------------------------------


def missing_embedding(works: DataFrame, column: str) -> DataFrame:
    """Rows without the embedding, with the text to embed and which column it came from."""
    from_ja = F.coalesce("japanese_name", F.lit("")) != ""
    return (
        works.filter(F.col(column).isNull())
        .withColumn("source_text", F.when(from_ja, F.col("japanese_name")).otherwise(F.col("title_name")))
        .withColumn("source", F.when(from_ja, F.lit("japanese_name")).otherwise(F.lit("title_name")))
        .filter(F.coalesce("source_text", F.lit("")) != "")
    )


def embed(df: DataFrame, text: str, out: str, dims: int, model: Callable[[], Callable] | None = None, method: str | None = None) -> DataFrame:
    """Add an embedding of a text column; blank and null texts give null.

    Without a model the native hash embedding is used. ``model`` is a loader: each Python worker
    calls it once and then encodes Arrow batches. A model that fails to load, or a batch it fails
    on, falls back to the hash embedding; ``method`` names a column that says which made each vector: model or hash.
    """
    clean = F.when(F.trim(F.coalesce(col(text), F.lit(""))) != "", col(text))
    fallback = hash_embedding(clean, dims)
    if model is None:
        made = df.withColumn(out, fallback)
        return made.withColumn(method, F.when(clean.isNotNull(), F.lit("hash"))) if method else made

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            encoder = model()
        except Exception:
            encoder = None
        for texts in batches:
            vectors = pd.Series([None] * len(texts), dtype=object)
            wanted = texts.notna()
            if encoder is not None and wanted.any():
                try:
                    found = [[float(x) for x in v] for v in encoder(texts[wanted].tolist())]
                    vectors[wanted.to_numpy()] = pd.Series(found, index=vectors.index[wanted.to_numpy()], dtype=object)
                except Exception:
                    pass
            yield vectors

    coded = df.withColumn("_text", clean).withColumn("_raw", encode("_text"))
    made = F.when(F.col("_raw").isNotNull(), fit("_raw", dims)).otherwise(hash_embedding(F.when(F.col("_raw").isNull(), F.col("_text")), dims))
    done = coded.withColumn(out, F.when(F.col("_text").isNotNull(), made))
    if method:
        by = F.when(F.col("_raw").isNotNull(), F.lit("model")).otherwise(F.lit("hash"))
        done = done.withColumn(method, F.when(F.col("_text").isNotNull(), by))
    return done.drop("_text", "_raw")


def backfill_embeddings(rows: DataFrame, column: str, dims: int, title: str, genre: str | None = None,
                        model: Callable[[], Callable] | None = None) -> DataFrame:
    """Rows with every missing embedding computed; rows without a text stay as they are.

    The new vectors are made in place, so no join is needed; ``status`` counts them, and ``method`` says what made them.
    """
    wanted = F.col(column).isNull() & F.col(title).isNotNull()
    text = embedding_text(title, F.col(genre) if genre else F.lit(None).cast("string"))
    made = embed(rows.withColumn("_t", F.when(wanted, text)), "_t", "_new", dims, model, method="method")
    fell_back = (F.col("method") == "hash") & F.lit(model is not None)
    return (
        made.withColumn("status", F.when(~wanted, "kept").when(fell_back, "fallback").when(F.col("method").isNotNull(), "added").otherwise("failed"))
        .withColumn(column, F.coalesce(F.col(column).cast("array<double>"), "_new")).drop("_t", "_new")
    )


def backfill_counts(backfilled: DataFrame) -> DataFrame:
    """Processed, successful and failed rows of a back-fill, and those a failing model left to the hash embedding."""
    status = F.col("status")
    return backfilled.agg(
        F.count_if(status != "kept").alias("processed"), F.count_if(status == "added").alias("success"),
        F.count_if(status == "failed").alias("failed"), F.count_if(status == "fallback").alias("fallbacks"),
    )


def copy_embeddings(target: DataFrame, source: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Embeddings of a snapshot written onto the rows of another; only filled columns are taken."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return update_existing(target, source.filter(some).select(key, *columns), key)


def author_id(name) -> Column:
    return entity_id(name, "author")
