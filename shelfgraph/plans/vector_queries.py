"""Similarity queries and embedding maintenance.

The query vector is the stored vector of one work, read from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgraph.functions import vectors as V
from shelfgraph.operators import quality as Q, search as S, vector as Ve
from shelfgraph.operators.limits import top_rows
from shelfgraph.operators.vector_cells import VectorCells
from shelfgraph.plans.binding import CREDITS_SQL, EXPAND_SQL, GRAPH_SQL, WORKS_SQL, catalogue, credits, embedded_titles, stored_catalogue, titles, vectors, with_sql, works
from shelfgraph.plans.registry import query, table
from shelfgraph.session import spread, work_dir

TITLE, DESCRIPTION = "embedding_title_en", "embedding_description"
_QUERY = 17

_COS = """
qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 17),
sims AS (
  SELECT 'work:' || vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s,
         list_cosine_similarity(CAST(embedding[1:16] AS DOUBLE[]), CAST(q[1:16] AS DOUBLE[])) AS s16
  FROM embeddings, qv JOIN part ON p_partkey = vec_id)"""


def query_vector(spark, sf, dims=None):
    """The stored query vector as a list: one row, read by its key."""
    row = table(spark, sf, "embeddings").filter(F.col("vec_id") == _QUERY).select("embedding").first()
    return [float(x) for x in row[0]][:dims]


@query("v1_similar_graph_nodes", with_sql(
    GRAPH_SQL, _COS, "seeds AS (SELECT id FROM sims ORDER BY round(s, 9) DESC, id LIMIT 20)", EXPAND_SQL, select="SELECT id, type, label FROM out_nodes"))
def v1(spark, sf):
    return Ve.similar_graph(catalogue(spark, sf), vectors(spark, sf), query_vector(spark, sf), TITLE, 20).node_rows()


@query("v1_similar_graph_edges", with_sql(
    GRAPH_SQL, _COS, "seeds AS (SELECT id FROM sims ORDER BY round(s, 9) DESC, id LIMIT 20)", EXPAND_SQL, select="SELECT src, dst, type FROM out_edges"))
def v1_edges(spark, sf):
    return Ve.similar_graph(catalogue(spark, sf), vectors(spark, sf), query_vector(spark, sf), TITLE, 20).edge_rows()


@query("v1_similarity_scores", with_sql(_COS, select="SELECT id, round(s, 6) AS similarity_score FROM sims"))
def v1_scores(spark, sf):
    return Ve.scored(vectors(spark, sf), query_vector(spark, sf), TITLE).select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("v2_similar_works", with_sql(WORKS_SQL, _COS, select="""
  SELECT s.id, title_name AS title_en, round(s, 6) AS similarity_score FROM sims s JOIN works w ON w.id = s.id
  WHERE s >= 0.1 AND genre <> 'PROMO' ORDER BY round(s, 9) DESC, s.id LIMIT 30"""))
def v2(spark, sf):
    hits = Ve.similar_works(vectors(spark, sf), titles(spark, sf), query_vector(spark, sf), TITLE, 30, 0.1, "PROMO")
    return hits.select("id", "title_en", F.round("similarity_score", 6).alias("similarity_score"))


@query("v2_similar_works_postfilter", with_sql(WORKS_SQL, _COS, select="""
  SELECT t.id, round(t.s, 6) AS similarity_score FROM sims t JOIN works w ON w.id = t.id
  WHERE s >= 0.2 AND genre <> 'PROMO' ORDER BY round(s, 9) DESC, t.id LIMIT 10"""))
def v2_post(spark, sf):
    """The excluded genre leaves before the cut, so the list is full whatever share of the nearest works it had."""
    hits = Ve.similar_works(vectors(spark, sf), titles(spark, sf), query_vector(spark, sf), TITLE, 10, 0.2, "PROMO")
    return hits.select("id", F.round("similarity_score", 6).alias("similarity_score"))


_CELLS: dict[tuple[str, str], VectorCells] = {}


def vector_cells(spark, sf):
    """The index of the works' vectors, written under the shared folder once an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CELLS:
        _CELLS[key] = VectorCells.write(vectors(spark, sf), work_dir(spark, "vector-cells"), TITLE)
    return _CELLS[key]


@query("v1_cells_graph_nodes", with_sql(
    GRAPH_SQL, _COS, "seeds AS (SELECT id FROM sims ORDER BY round(s, 9) DESC, id LIMIT 20)", EXPAND_SQL, select="SELECT id, type, label FROM out_nodes"))
def v1_cells(spark, sf):
    return Ve.similar_graph(stored_catalogue(spark, sf).graph, vector_cells(spark, sf), query_vector(spark, sf), TITLE, 20).node_rows()


@query("v2_cells_similar_works", with_sql(WORKS_SQL, _COS, select="""
  SELECT s.id, title_name AS title_en, round(s, 6) AS similarity_score FROM sims s JOIN works w ON w.id = s.id
  WHERE s >= 0.1 AND genre <> 'PROMO' ORDER BY round(s, 9) DESC, s.id LIMIT 30"""))
def v2_cells(spark, sf):
    hits = Ve.similar_works(vector_cells(spark, sf), titles(spark, sf), query_vector(spark, sf), TITLE, 30, 0.1, "PROMO")
    return hits.select("id", "title_en", F.round("similarity_score", 6).alias("similarity_score"))


@query("v3_multi_column", with_sql(_COS, select="""
  SELECT id, round(max(s), 6) AS similarity_score FROM (
    (SELECT id, s FROM sims WHERE s >= 0.1 ORDER BY round(s, 9) DESC, id LIMIT 20) UNION ALL
    (SELECT id, s16 FROM sims WHERE s16 >= 0.1 ORDER BY round(s16, 9) DESC, id LIMIT 20)) t(id, s)
  GROUP BY id ORDER BY round(max(s), 9) DESC, id LIMIT 20"""))
def v3(spark, sf):
    """The whole vector and its leading 16 components are two columns searched with their own query length."""
    q = query_vector(spark, sf)
    both = vectors(spark, sf).withColumn(DESCRIPTION, V.fit(F.slice(TITLE, 1, 16), 64))
    best = Ve.similar_works_multi(both, titles(spark, sf), {TITLE: q, DESCRIPTION: V.fit(F.slice(V.vector_literal(q), 1, 16), 64)}, [TITLE, DESCRIPTION], 20, 0.1, None)
    return best.select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("v3_multi_column_lists", with_sql(_COS, select="""
  SELECT id, round(s, 6) AS similarity_score FROM sims WHERE s >= 0.1 ORDER BY round(s, 9) DESC, id LIMIT 20"""))
def v3_lists(spark, sf):
    w = vectors(spark, sf).withColumn("embedding_title_ja", F.col(TITLE))
    hits = Ve.similar_works_multi(w, titles(spark, sf), query_vector(spark, sf), [TITLE, "embedding_title_ja", "unknown"], 20, 0.1, None)
    return hits.select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("v4_nearest_to_work", with_sql(_COS, select="SELECT id, round(s, 6) AS similarity_score FROM sims ORDER BY round(s, 9) DESC, id LIMIT 10"))
def v4(spark, sf):
    hits = Ve.nearest_to_work(vectors(spark, sf), f"work:{_QUERY}", TITLE, 10)
    return hits.select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("v5_similar_titles", with_sql(WORKS_SQL, _COS, select="""
  SELECT title_name AS title, round(s, 6) AS similarity_score FROM sims s JOIN works w ON w.id = s.id WHERE s >= 0.3 ORDER BY round(s, 9) DESC, s.id LIMIT 5"""))
def v5(spark, sf):
    hits = Ve.similar_titles(vectors(spark, sf), titles(spark, sf), query_vector(spark, sf), TITLE, 5, 0.3)
    return hits.select("title", F.round("similarity_score", 6).alias("similarity_score"))


_HITS = "hits AS (SELECT id, s FROM sims WHERE s >= 0.2 ORDER BY round(s, 9) DESC, id LIMIT 15)"


def _hits(spark, sf):
    return Ve.nearest(vectors(spark, sf), titles(spark, sf), query_vector(spark, sf), TITLE, 15, 0.2, None)


@query("v6_fuzzy_vector_nodes", with_sql(WORKS_SQL, CREDITS_SQL, _COS, _HITS, select="""
  SELECT id, 'work' AS type FROM hits UNION ALL SELECT DISTINCT 'author_' || name, 'author' FROM credits WHERE kind = 'creator' AND work_id IN (SELECT id FROM hits)"""))
def v6(spark, sf):
    return Ve.hits_with_creators(_hits(spark, sf), credits(spark, sf)).nodes.select("id", "type")


@query("r10_hits_with_creators", with_sql(WORKS_SQL, CREDITS_SQL, _COS, _HITS, select="""
  SELECT work_id AS src, 'author_' || name AS dst, 'CREATED_BY' AS type FROM credits WHERE kind = 'creator' AND work_id IN (SELECT id FROM hits)"""))
def r10(spark, sf):
    return Ve.hits_with_creators(_hits(spark, sf), credits(spark, sf)).edge_rows()


@query("v7_vector_search", with_sql(_COS, select="SELECT id, round((1 + s) / 2, 6) AS similarity_score FROM sims ORDER BY round((1 + s) / 2, 9) DESC, id LIMIT 10"))
def v7(spark, sf):
    hits = Ve.scored(vectors(spark, sf), query_vector(spark, sf), TITLE, unit=True)
    return top_rows(hits, 10, *Ve.by_similarity()).select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("v8_hybrid", with_sql(WORKS_SQL, _COS, """
t AS (SELECT id FROM works WHERE contains(title_name, 'red') OR contains(english_name, 'red') ORDER BY members DESC, p_partkey LIMIT 25),
v AS (SELECT id, s FROM sims ORDER BY round(s, 9) DESC, id LIMIT 25),
b AS (SELECT coalesce(t.id, v.id) AS id, CASE WHEN s IS NULL THEN 0.7 WHEN t.id IS NULL THEN s ELSE least(1.0, greatest(0.7, s) + 0.1) END AS score FROM t FULL JOIN v ON v.id = t.id)""",
    select="SELECT id, round(score, 6) AS search_score FROM b ORDER BY round(score, 9) DESC, id LIMIT 50"))
def v8(spark, sf):
    text = S.simple_hits(works(spark, sf), "red", 25)
    near = Ve.nearest(vectors(spark, sf), titles(spark, sf), query_vector(spark, sf), TITLE, 25, None, None)
    return Ve.hybrid(text, near, 50).select("id", F.round("search_score", 6).alias("search_score"))


@query("v9_truncate", "SELECT vec_id, len(embedding[1:16]) AS dims, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def v9(spark, sf):
    cut = table(spark, sf, "embeddings").select("vec_id", V.truncate("embedding", 16).alias("v"))
    return cut.select("vec_id", F.size("v").cast("bigint").alias("dims"), F.round(F.aggregate(V.as_doubles("v"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("v10_fit", "SELECT vec_id, 80 AS dims, round(embedding[64]::DOUBLE, 6) AS last_kept, 0.0::DOUBLE AS padding FROM embeddings")
def v10(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", V.fit("embedding", 80).alias("v"))
    return v.select("vec_id", F.size("v").alias("dims"), F.round(F.get("v", F.lit(63)), 6).alias("last_kept"), F.get("v", F.lit(79)).alias("padding"))


_HASHED = """
hashed AS (SELECT {key} AS id, concat(sha256({t} || '0'), sha256({t} || '1'), sha256({t} || '2'), sha256({t} || '3'), sha256({t} || '4'), sha256({t} || '5')) AS h FROM {src}),
dims AS (SELECT unnest(range({n})) AS i),
parts AS (SELECT id, i, (strpos('0123456789abcdef', substr(h, (i % 384)::INTEGER + 1, 1)) - 1) / 15.0 - 0.5 + ((i % 100) / 10000.0 - 0.005) AS x FROM hashed, dims)"""


@query("v11_hash_embedding", with_sql(
    _HASHED.format(key="doc_id", t="text", src="documents", n=16), select="SELECT id AS doc_id, i AS position, round(x, 9) AS x FROM parts"))
def v11(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", V.hash_embedding("text", 16).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("position", "x")).select(
        "doc_id", F.col("position").cast("bigint").alias("position"), F.round("x", 9).alias("x"))


# Components are whole multiples of 1/30000, so a digest of these whole numbers compares all of a vector.
_DIGEST = "SELECT id AS {key}, count(*) AS dims, md5(string_agg(round(x * 30000)::BIGINT::VARCHAR, ',' ORDER BY i)) AS digest FROM parts GROUP BY id"


def digested(df, key: str, vector: str):
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 30000 + 0.5).cast("string"))
    return df.select(key, F.size(vector).cast("bigint").alias("dims"), F.md5(F.array_join(whole, ",")).alias("digest"))


@query("v11_hash_embedding_whole", with_sql(_HASHED.format(key="doc_id", t="text", src="documents", n=1536), select=_DIGEST.format(key="doc_id")))
def v11_whole(spark, sf):
    v = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", V.hash_embedding("text").alias("v"))
    return digested(v, "doc_id", "v")


def length_model():
    """A tiny encoder for the model path: text length and vowels."""
    return lambda texts: [[float(len(t)), float(sum(t.count(c) for c in "aeiou"))] for t in texts]


@query("v12_embed_column", """
  SELECT p_partkey, CASE WHEN p_size > 10 THEN length(p_name)::DOUBLE END AS a, CASE WHEN p_size > 10 THEN length(regexp_replace(p_name, '[^aeiou]', '', 'g'))::DOUBLE END AS b,
         CASE WHEN p_size > 10 THEN 0.0::DOUBLE END AS c FROM part""")
def v12(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ").alias("t"))
    v = Ve.embed(rows, "t", "v", 3, length_model)
    return v.select("p_partkey", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), F.get("v", F.lit(2)).alias("c"))


@query("v13_missing_embeddings", with_sql(WORKS_SQL, select="""
  SELECT id, coalesce(japanese_name, title_name) AS source_text, CASE WHEN japanese_name IS NULL THEN 'title_name' ELSE 'japanese_name' END AS source
  FROM works WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)"""))
def v13(spark, sf):
    return Ve.missing_embedding(embedded_titles(spark, sf), TITLE).select("id", "source_text", "source")


@query("v14_embedding_text", "SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END AS text FROM part")
def v14(spark, sf):
    genre = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", V.embedding_text("p_name", genre).alias("text"))


def _backfilled(spark, sf, dims=8):
    return Ve.backfill_embeddings(spread(embedded_titles(spark, sf), "id"), TITLE, dims, "title_name", "genre")


@query("v15_backfill", with_sql(
    WORKS_SQL, "lacking AS (SELECT id, title_name || ' ' || genre AS t FROM works WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings))",
    _HASHED.format(key="id", t="t", src="lacking", n=8), select="SELECT id, i AS position, round(x, 9) AS x FROM parts"))
def v15(spark, sf):
    added = _backfilled(spark, sf).filter("status = 'added'")
    return added.select("id", F.posexplode(TITLE).alias("position", "x")).select(
        "id", F.col("position").cast("bigint").alias("position"), F.round("x", 9).alias("x"))


@query("v15_backfill_whole", with_sql(
    WORKS_SQL, "lacking AS (SELECT id, title_name || ' ' || genre AS t FROM works WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings))",
    _HASHED.format(key="id", t="t", src="lacking", n=1536), select=_DIGEST.format(key="id")))
def v15_whole(spark, sf):
    return digested(_backfilled(spark, sf, 1536).filter("status = 'added'"), "id", TITLE)


@query("v15_backfill_counts", "SELECT count(*) AS processed, count(*) AS success, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS fallbacks FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def v15_counts(spark, sf):
    return Ve.backfill_counts(_backfilled(spark, sf))


@query("v16_copy_embeddings", "SELECT p_partkey AS id, vec_id IS NOT NULL AS has_vector, round(embedding[1]::DOUBLE, 6) AS first FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def v16(spark, sf):
    target = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("array<float>").alias(TITLE))
    source = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias(TITLE))
    out = Ve.copy_embeddings(target, source, [TITLE])
    return out.select("id", F.col(TITLE).isNotNull().alias("has_vector"), F.round(F.get(TITLE, F.lit(0)).cast("double"), 6).alias("first"))


def _fallen_back(spark, sf, dims):
    def broken():
        raise RuntimeError("no such model")

    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return Ve.embed(spread(rows, "id"), "c_name", "v", dims, broken)


@query("u1_embedder_fallback", with_sql(
    _HASHED.format(key="c_custkey", t="c_name", src="customer", n=4), select="SELECT id, i AS position, round(x, 9) AS x FROM parts"))
def u1(spark, sf):
    """A model that cannot be loaded: every row falls back to the hash embedding."""
    v = _fallen_back(spark, sf, 4)
    return v.select("id", F.posexplode("v").alias("position", "x")).select("id", F.col("position").cast("bigint").alias("position"), F.round("x", 9).alias("x"))


@query("u1_embedder_fallback_whole", with_sql(_HASHED.format(key="c_custkey", t="c_name", src="customer", n=1536), select=_DIGEST.format(key="id")))
def u1_whole(spark, sf):
    return digested(_fallen_back(spark, sf, 1536), "id", "v")
