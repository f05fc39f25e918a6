"""Search, expansion, filter and related-work queries over the bound graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgraph.graph import Graph
from shelfgraph.operators import expand as X, filters as Fi, related as R, search as S, tabular as Tb
from shelfgraph.operators.limits import first_per_key, top_rows
from shelfgraph.operators.upsert import dangling_edges
from shelfgraph.plans.binding import (
    AS_OF_YEAR, CREDITS_SQL, EDGES_SQL, EXPAND_SQL, GRAPH_SQL, NODES_SQL, WORKS_SQL, catalogue, catalogue_view, credits, stored_catalogue, titles, with_sql, works,
)
from shelfgraph.plans.registry import query, table

TERM = "red"
_RED = "(contains(lower(title_name), 'red') OR contains(lower(english_name), 'red'))"
_SEEDS = f"seeds AS (SELECT id FROM works WHERE {_RED} ORDER BY members DESC, p_partkey LIMIT 20)"
_PROMO = "(SELECT id FROM works WHERE contains(lower(genre), 'promo'))"
_OUT_NODES = "SELECT id, type, label FROM out_nodes"
_OUT_EDGES = "SELECT src, dst, type FROM out_edges"


def _seeds(graph):
    return S.simple_hits(graph.of_type("work"), TERM, 20)


# Search ---------------------------------------------------------------------------------------


@query("q1_simple_search_nodes", with_sql(GRAPH_SQL, _SEEDS, EXPAND_SQL, select=f"{_OUT_NODES} WHERE id NOT IN {_PROMO}"))
def q1_nodes(spark, sf):
    return S.search(catalogue(spark, sf), TERM, 20, exclude="promo").node_rows()


@query("q1_simple_search_edges", with_sql(
    GRAPH_SQL, _SEEDS, EXPAND_SQL, select=f"{_OUT_EDGES} WHERE src NOT IN {_PROMO} AND dst NOT IN {_PROMO}"))
def q1_edges(spark, sf):
    return S.search(catalogue(spark, sf), TERM, 20, exclude="promo").edge_rows()


# The same over the stored graph and its indexes: candidates by trigram, edges and neighbours from the files that hold them.
@query("q1_stored_nodes", with_sql(GRAPH_SQL, _SEEDS, EXPAND_SQL, select=f"{_OUT_NODES} WHERE id NOT IN {_PROMO}"))
def q1_stored(spark, sf):
    kept = stored_catalogue(spark, sf)
    return S.search(kept.graph, TERM, 20, exclude="promo", substrings=kept.titles).node_rows()


@query("q1_stored_edges", with_sql(
    GRAPH_SQL, _SEEDS, EXPAND_SQL, select=f"{_OUT_EDGES} WHERE src NOT IN {_PROMO} AND dst NOT IN {_PROMO}"))
def q1_stored_edges(spark, sf):
    kept = stored_catalogue(spark, sf)
    return S.search(kept.graph, TERM, 20, exclude="promo", substrings=kept.titles).edge_rows()


# Full text: BM25 over the words of the title columns; the last word may differ by one edit.
def _bm25(words: list[str], fuzzy: str, limit: int | None, where: str = "true") -> str:
    exact = ", ".join(f"'{w}'" for w in words)
    return f"""
docs AS (
  SELECT id, members, p_partkey, title_name, japanese_name, string_split(concat_ws(' ', lower(title_name), lower(english_name), japanese_name), ' ') AS tokens FROM works),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM docs),
words AS (SELECT id, len(tokens) AS dl, japanese_name, unnest(tokens) AS w FROM docs),
hits AS (SELECT id, dl, japanese_name, w, count(*) AS tf FROM words WHERE w IN ({exact}) OR levenshtein(w, '{fuzzy}') <= 1 GROUP BY ALL),
dfs AS (SELECT w, count(DISTINCT id) AS df FROM hits GROUP BY w),
scored AS (
  SELECT id, sum(CASE WHEN hits.w IN ({exact}) THEN 1.0 ELSE 1 - 1.0 / least(length(hits.w), {len(fuzzy)}) END
             * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS score
  FROM hits JOIN dfs ON dfs.w = hits.w, corpus WHERE {where} GROUP BY id),
best AS (SELECT id, score FROM scored ORDER BY round(score, 9) DESC, id {"" if limit is None else f"LIMIT {limit}"}),
pool AS (SELECT id, score / max(score) OVER () AS score FROM best)"""


@query("q2_fulltext_hits", with_sql(WORKS_SQL, _bm25(["red", "rinq"], "rinq", 50), select="SELECT id, round(score, 6) AS score FROM pool"))
def q2_hits(spark, sf):
    hits = S.fulltext_hits(titles(spark, sf), "red rinq", 50)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("q2_stored_hits", with_sql(WORKS_SQL, _bm25(["red", "rinq"], "rinq", 50), select="SELECT id, round(score, 6) AS score FROM pool"))
def q2_stored(spark, sf):
    kept = stored_catalogue(spark, sf)
    hits = S.fulltext_hits(kept.works, "red rinq", 50, index=kept.tokens)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("q2_fulltext_scores_japanese", with_sql(
    WORKS_SQL, _bm25(["redrinq"], "redrinq", 100, "japanese_name <> ''"), select="SELECT id, round(score, 6) AS score FROM scored"))
def q2_scores(spark, sf):
    return S.fulltext_scores(titles(spark, sf), "redrinq", Fi.JAPANESE).select("id", F.round("score", 6).alias("score"))


@query("q2_fulltext_graph_nodes", with_sql(
    GRAPH_SQL, _bm25(["red", "rinq"], "rinq", 20), "seeds AS (SELECT id FROM pool)", EXPAND_SQL, select=_OUT_NODES))
def q2_nodes(spark, sf):
    return S.search(catalogue(spark, sf), "red rinq", 20, mode="fulltext").node_rows()


def _signs(rows, signs):
    """Works whose Japanese title is their title with another sign for each letter."""
    none = F.lit(None).cast("string")
    return rows.withColumns({"japanese_name": F.translate("title_name", _LATIN, signs), "english_name": none, "title": none}).withColumn("title_name", none)


def _signs_sql(signs: str, token: str, test: str, boost: str = "1") -> str:
    """BM25 over the tokens that ``token`` makes of each word of the sign titles."""
    return with_sql(WORKS_SQL, f"""
pieces AS (SELECT id, unnest({token}) AS t FROM (SELECT id, unnest(string_split(translate(p_name, '{_LATIN}', '{signs}'), ' ')) AS w FROM works JOIN part USING (p_partkey))),
lengths AS (SELECT id, count(*) AS dl FROM pieces GROUP BY id),
corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM lengths),
hits AS (SELECT id, t, count(*) AS tf FROM pieces WHERE {test} GROUP BY ALL),
dfs AS (SELECT t, count(*) AS df FROM hits GROUP BY t)""", select=f"""
  SELECT id, round(sum({boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM hits JOIN dfs USING (t) JOIN lengths USING (id), corpus GROUP BY id""")


# Titles written in katakana, whose runs are tokens, and in Han characters, which are tokens by themselves.
_LATIN, _KANA = "abcdefghijklmnopqrstuvwxyz", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
_HAN = "鋼錬金術師進撃巨人海賊王火影忍者東京喰種鬼滅刃呪廻戦銀"
_in = lambda word, signs: "".join(signs[_LATIN.index(c)] for c in word)


# A sign stands for one letter, so the SQL can count edits, which DuckDB counts in bytes, on the letters.
@query("q2_fulltext_katakana", _signs_sql(
    _LATIN, "[w]", "levenshtein(t, 'rinq') <= 1", "(CASE WHEN t = 'rinq' THEN 1.0 ELSE 1 - 1.0 / least(length(t), 4) END)"))
def q2_katakana(spark, sf):
    rows = _signs(titles(spark, sf), _KANA)
    return S.fulltext_scores(rows, _in("rinq", _KANA), Fi.JAPANESE).select("id", F.round("score", 6).alias("score"))


@query("q2_fulltext_han", _signs_sql(_HAN, "string_split(w, '')", f"t IN ('{_HAN[17]}', '{_HAN[8]}')"))
def q2_han(spark, sf):
    """A search for two characters finds the titles that hold either, wherever it stands."""
    rows = _signs(titles(spark, sf), _HAN)
    return S.fulltext_scores(rows, _in("ri", _HAN), Fi.JAPANESE).select("id", F.round("score", 6).alias("score"))


@query("q2_fulltext_han_phrase", f"SELECT 'work:' || p_partkey AS id FROM part WHERE contains(translate(p_name, '{_LATIN}', '{_HAN}'), '{_in('ring', _HAN)}')")
def q2_phrase(spark, sf):
    rows = _signs(titles(spark, sf), _HAN)
    return S.fulltext_scores(rows, _in("ring", _HAN), Fi.JAPANESE, phrase=True).select("id")


@query("q2_fulltext_folded", with_sql(WORKS_SQL, _bm25(["goss"], "goss", None), select="SELECT id, round(score, 6) AS score FROM scored")
       .replace("concat_ws(' ', lower(title_name), lower(english_name), japanese_name)", "replace(lower(title_name), 'ld', 'ss')"))
def q2_folded(spark, sf):
    """Titles with \u00df and accents, found by words without them: 'old' stands as 'o\u00df', 'gold' and 'cold' alike."""
    none = F.lit(None).cast("string")
    rows = titles(spark, sf).withColumn("title_name", F.translate(F.replace("title_name", F.lit("ld"), F.lit("\u00df")), "aeo", "\u00e1\u00e8\u014d"))
    rows = rows.withColumns({"english_name": none, "japanese_name": none, "title": none})
    return S.fulltext_scores(rows, "goss").select("id", F.round("score", 6).alias("score"))


_RANKED = _bm25(["red", "rinq"], "rinq", None) + """,
rescored AS (
  SELECT p.id, 0.5 * score + 0.5 * (1 - levenshtein(lower(title_name), 'red rinq') / greatest(length(title_name), 8)::DOUBLE) AS final_score
  FROM pool p JOIN works w ON w.id = p.id),
ranked AS (SELECT id, final_score FROM rescored WHERE final_score >= 0.45 ORDER BY round(final_score, 9) DESC, id LIMIT 50)"""


@query("q3_ranked_hits", with_sql(WORKS_SQL, _RANKED, select="SELECT id, round(final_score, 6) AS final_score FROM ranked"))
def q3_hits(spark, sf):
    hits = S.ranked_hits(titles(spark, sf), "red rinq", 50)
    return hits.select("id", F.round("final_score", 6).alias("final_score"))


@query("q3_stored_hits", with_sql(WORKS_SQL, _RANKED, select="SELECT id, round(final_score, 6) AS final_score FROM ranked"))
def q3_stored(spark, sf):
    kept = stored_catalogue(spark, sf)
    hits = S.ranked_hits(kept.works, "red rinq", 50, index=kept.tokens)
    return hits.select("id", F.round("final_score", 6).alias("final_score"))


@query("q3_ranked_graph_edges", with_sql(GRAPH_SQL, _RANKED, "seeds AS (SELECT id FROM ranked)", EXPAND_SQL, select=_OUT_EDGES))
def q3_edges(spark, sf):
    return S.search(catalogue(spark, sf), "red rinq", 50, mode="ranked").edge_rows()


@query("q4_cascade_substring_stage", with_sql(
    GRAPH_SQL, """seeds AS (SELECT id FROM works WHERE contains(japanese_name, 'dri') OR contains(title_name, 'dri') ORDER BY members DESC, p_partkey LIMIT 3)""",
    EXPAND_SQL, select=_OUT_NODES))
def q4_simple(spark, sf):
    """No indexed word is near "dri", so the substring stage of the first language answers."""
    return S.cascade(catalogue(spark, sf), "dri", 3).node_rows()


@query("q4_cascade_first_stage", with_sql(
    GRAPH_SQL, _bm25(["redring"], "redring", None, "japanese_name <> ''"), """
rescored AS (
  SELECT p.id, 0.5 * score + 0.5 * (1 - levenshtein(lower(japanese_name), 'redring') / greatest(length(japanese_name), 7)::DOUBLE) AS final_score
  FROM pool p JOIN works w ON w.id = p.id),
seeds AS (SELECT id FROM rescored WHERE final_score >= 0.45 ORDER BY round(final_score, 9) DESC, id LIMIT 3)""",
    EXPAND_SQL, select=_OUT_NODES))
def q4_ranked(spark, sf):
    return S.cascade(catalogue(spark, sf), "redring", 3).node_rows()


_LEGACY = """
named AS (SELECT id, type, label FROM nodes WHERE contains(lower(label), 'a') ORDER BY id LIMIT 10),
both_ends AS (
  SELECT src, dst, type, src AS here, dst AS other FROM edges WHERE src IN (SELECT id FROM named)
  UNION ALL SELECT src, dst, type, dst, src FROM edges WHERE dst IN (SELECT id FROM named)),
few AS (SELECT * FROM both_ends ORDER BY sha256(src || chr(1) || type || chr(1) || dst), here LIMIT 50)"""


@query("q5_name_search_nodes", with_sql(
    GRAPH_SQL, _LEGACY, select="SELECT id, type, label FROM nodes WHERE id IN (SELECT id FROM named UNION SELECT other FROM few)"))
def q5_nodes(spark, sf):
    return S.name_search(catalogue(spark, sf), "a", 10, 50).node_rows()


@query("q5_name_search_edges", with_sql(GRAPH_SQL, _LEGACY, select="SELECT DISTINCT src, dst, lower(type) AS type FROM few"))
def q5_edges(spark, sf):
    return S.name_search(catalogue(spark, sf), "a", 10, 50).edge_rows()


@query("q5_stored_nodes", with_sql(
    GRAPH_SQL, _LEGACY.replace("'a'", "'lier'"), select="SELECT id, type, label FROM nodes WHERE id IN (SELECT id FROM named UNION SELECT other FROM few)"))
def q5_stored(spark, sf):
    kept = stored_catalogue(spark, sf)
    return S.name_search(kept.graph, "lier", 10, 50, kept.titles).node_rows()


@query("q6_stored_subgraph", with_sql(
    GRAPH_SQL, "seeds AS (SELECT 'work:7' AS id)", EXPAND_SQL,
    select="SELECT id, type, label FROM nodes WHERE id = 'work:7' OR id IN (SELECT other FROM touching)"))
def q6_stored(spark, sf):
    return R.work_subgraph(stored_catalogue(spark, sf).graph, "work:7").node_rows()


@query("q6_work_subgraph", with_sql(
    GRAPH_SQL, "seeds AS (SELECT 'work:7' AS id)", EXPAND_SQL,
    select="SELECT id, type, label FROM nodes WHERE id = 'work:7' OR id IN (SELECT other FROM touching)"))
def q6(spark, sf):
    return R.work_subgraph(catalogue(spark, sf), "work:7").node_rows()


_AUTHOR = """
hit AS (SELECT w.id, w.label FROM works w JOIN edges e ON e.src = w.id WHERE e.type = 'CREATED_BY' AND e.dst = 'author:3' ORDER BY lower(title_name), w.id LIMIT 25)"""


@query("q7_author_works_nodes", with_sql(
    GRAPH_SQL, _AUTHOR, select="SELECT id, 'work' AS type, label FROM hit UNION ALL SELECT id, type, label FROM nodes WHERE id = 'author:3' AND EXISTS (SELECT 1 FROM hit)"))
def q7_nodes(spark, sf):
    return R.author_works(catalogue(spark, sf), "author:3", 25).node_rows()


@query("q7_author_works_edges", with_sql(GRAPH_SQL, _AUTHOR, select="SELECT id AS src, 'author:3' AS dst, 'CREATED_BY' AS type FROM hit"))
def q7_edges(spark, sf):
    return R.author_works(catalogue(spark, sf), "author:3", 25).edge_rows()


def _scores(ref: str) -> str:
    return f"""
refw AS (SELECT * FROM works WHERE id = '{ref}'),
scored AS (
  SELECT w.id, w.label, w.title_name, CASE WHEN w.demographic = r.demographic THEN 2 ELSE 0 END AS demo_score,
         len(list_filter(r.themes, lambda x: list_contains(w.themes, x))) AS themes_score,
         len(list_filter(r.themes, lambda x: list_contains(w.themes, x)))::DOUBLE / len(r.themes) AS themes_ratio,
         CASE WHEN w.first_year IS NULL OR r.first_year IS NULL OR least(w.last_year, r.last_year) < greatest(w.first_year, r.first_year) THEN 0.0
           ELSE (least(w.last_year, r.last_year) - greatest(w.first_year, r.first_year) + 1)::DOUBLE
             / ((r.last_year - r.first_year + 1) + (w.last_year - w.first_year + 1) - (least(w.last_year, r.last_year) - greatest(w.first_year, r.first_year) + 1)) END AS date_jaccard
  FROM works w, refw r WHERE w.id <> r.id)"""


_RANK = "demo_score DESC, themes_score DESC, themes_ratio DESC, date_jaccard DESC, lower(title_name), id"


@query("q8_magazine_works", with_sql(
    GRAPH_SQL, "hit AS (SELECT w.id, w.label FROM works w JOIN edges e ON e.src = w.id WHERE e.type = 'PUBLISHED_IN' AND e.dst = 'magazine:4' ORDER BY lower(title_name), w.id LIMIT 25)",
    select="SELECT id, 'work' AS type, label FROM hit UNION ALL SELECT id, type, label FROM nodes WHERE id = 'magazine:4' AND EXISTS (SELECT 1 FROM hit)"))
def q8_plain(spark, sf):
    return R.magazine_works(catalogue(spark, sf), "magazine:4", 25).node_rows()


@query("q8_magazine_works_ranked", with_sql(GRAPH_SQL, _scores("work:7"), select=f"""
  SELECT s.id, demo_score, themes_score, round(themes_ratio, 6) AS themes_ratio, round(date_jaccard, 6) AS date_jaccard
  FROM scored s JOIN edges e ON e.src = s.id WHERE e.type = 'PUBLISHED_IN' AND e.dst = 'magazine:4' ORDER BY {_RANK.replace('id', 's.id')} LIMIT 25"""))
def q8_ranked(spark, sf):
    g = R.magazine_works(catalogue(spark, sf), "magazine:4", 25, "work:7", AS_OF_YEAR)
    return g.of_type("work").select("id", "demo_score", F.col("themes_score").cast("bigint").alias("themes_score"),
                                    F.round("themes_ratio", 6).alias("themes_ratio"), F.round("date_jaccard", 6).alias("date_jaccard"))


@query("q9_publisher_magazines", """
  SELECT 'magazine:' || n_nationkey AS src, 'publisher:2' AS dst, 'PUBLISHED_BY' AS type FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 7
  ORDER BY lower(n_name), src LIMIT 50""")
def q9(spark, sf):
    return R.publisher_magazines(catalogue(spark, sf), "publisher:2", 50, exclude_id="magazine:7").edge_rows()


def _per_magazine(ids: str, order: str, k: int) -> str:
    return f"""
picked AS (
  SELECT e.dst AS magazine_id, s.id FROM scored s JOIN edges e ON e.src = s.id WHERE e.type = 'PUBLISHED_IN' AND {ids}
  QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY {order.replace(' id', ' s.id')}) <= {k})"""


_THREE = ["magazine:1", "magazine:4", "magazine:9"]
_THREE_SQL = "e.dst IN ('magazine:1', 'magazine:4', 'magazine:9')"


@query("q10_magazines_graph_nodes", with_sql(
    GRAPH_SQL, _scores("work:7"), _per_magazine(_THREE_SQL, _RANK, 10),
    select="SELECT id, type, label FROM nodes WHERE id IN (SELECT id FROM picked) OR id IN ('magazine:1', 'magazine:4', 'magazine:9')"))
def q10_nodes(spark, sf):
    return R.magazines_work_graph(catalogue(spark, sf), _THREE, 10, "work:7", AS_OF_YEAR).node_rows()


@query("q10_magazines_graph_edges", with_sql(
    GRAPH_SQL, "scored AS (SELECT id, title_name FROM works)", _per_magazine(_THREE_SQL, "lower(title_name), id", 10),
    select="SELECT id AS src, magazine_id AS dst, 'PUBLISHED_IN' AS type FROM picked"))
def q10_edges(spark, sf):
    return R.magazines_work_graph(catalogue(spark, sf), _THREE, 10).edge_rows()


# Same publisher, other magazines ----------------------------------------------------------------

_SAME_PUBLISHER = """
anchor AS (SELECT id, first_year AS a0, last_year AS a1 FROM works WHERE id = 'work:11'),
own AS (SELECT dst FROM edges WHERE type = 'PUBLISHED_IN' AND src = 'work:11'),
pubs AS (SELECT DISTINCT dst FROM edges WHERE type = 'PUBLISHED_BY' AND src IN (SELECT dst FROM own)),
mags AS (SELECT src FROM edges WHERE type = 'PUBLISHED_BY' AND dst IN (SELECT dst FROM pubs) AND src NOT IN (SELECT dst FROM own)),
same_author AS (SELECT DISTINCT src FROM edges WHERE type = 'CREATED_BY' AND dst IN (SELECT dst FROM edges WHERE type = 'CREATED_BY' AND src = 'work:11')),
near AS (
  SELECT w.id, min(e.dst) AS magazine_id, any_value(w.id IN (SELECT src FROM same_author)) AS same_author, any_value(total_volumes) AS total_volumes,
         any_value(greatest(least(last_year, a1) - greatest(first_year, a0) + 1, 0)) AS overlap_years,
         any_value(greatest(first_year - a1, a0 - last_year, 0)) AS period_gap,
         any_value(greatest(least(last_year, a1) - greatest(first_year, a0) + 1, 0)::DOUBLE
           / ((a1 - a0 + 1) + (last_year - first_year + 1) - greatest(least(last_year, a1) - greatest(first_year, a0) + 1, 0))) AS jaccard
  FROM works w JOIN edges e ON e.src = w.id AND e.type = 'PUBLISHED_IN' AND e.dst IN (SELECT src FROM mags), anchor
  WHERE w.id <> 'work:11' AND last_year >= a0 - {w} AND first_year <= a1 + {w} GROUP BY w.id)"""


@query("j8_same_publisher", with_sql(GRAPH_SQL, _SAME_PUBLISHER.format(w=0), select="""
  SELECT id, magazine_id, overlap_years, period_gap, round(jaccard, 6) AS jaccard_similarity, same_author FROM near"""))
def j8(spark, sf):
    rows = R.same_publisher_other_magazines(catalogue(spark, sf), "work:11", 0)
    return rows.select("id", "magazine_id", "overlap_years", "period_gap", F.round("jaccard_similarity", 6).alias("jaccard_similarity"), "same_author")


@query("j8_same_publisher_top", with_sql(GRAPH_SQL, _SAME_PUBLISHER.format(w=2), select="""
  SELECT id, overlap_years FROM near ORDER BY same_author, round(jaccard, 9) DESC, overlap_years DESC, period_gap, id LIMIT 5"""))
def j8_top(spark, sf):
    return R.same_publisher_other_magazines(catalogue(spark, sf), "work:11", 2, limit=5).select("id", "overlap_years")


# Every fiftieth work as an anchor, against all works.
@query("j8_pairs_of_anchors", with_sql(GRAPH_SQL, """
placed AS (SELECT e.src AS id, e.dst AS magazine_id, p.dst AS publisher_id FROM edges e JOIN edges p ON p.src = e.dst AND p.type = 'PUBLISHED_BY' WHERE e.type = 'PUBLISHED_IN'),
own AS (SELECT * FROM placed WHERE id IN (SELECT id FROM works WHERE p_partkey % 50 = 0)),
theirs AS (SELECT DISTINCT o.id AS anchor_id, t.id, t.magazine_id FROM own o JOIN placed t ON o.publisher_id = t.publisher_id AND t.id <> o.id),
chosen AS (SELECT anchor_id, id, min(magazine_id) AS magazine_id FROM theirs WHERE (anchor_id, magazine_id) NOT IN (SELECT (id, magazine_id) FROM own) GROUP BY anchor_id, id)""", select="""
  SELECT anchor_id, c.id, magazine_id, greatest(0, least(w.last_year, a.last_year) - greatest(w.first_year, a.first_year) + 1)::INT AS overlap_years
  FROM chosen c JOIN works a ON a.id = anchor_id JOIN works w ON w.id = c.id WHERE w.last_year >= a.first_year - 2 AND w.first_year <= a.last_year + 2"""))
def j8_pairs(spark, sf):
    g = catalogue(spark, sf)
    anchors = g.of_type("work").filter(F.col("work_id").cast("bigint") % 50 == 0)
    return R.same_publisher_pairs(g, anchors, 2).select("anchor_id", "id", "magazine_id", F.col("overlap_years").cast("int").alias("overlap_years"))


@query("j9_pairs_of_anchors", with_sql(WORKS_SQL, select="""
  SELECT a.id AS anchor_id, w.id, (least(w.last_year, a.last_year) - greatest(w.first_year, a.first_year) + 1)::INT AS overlap_years
  FROM works a JOIN works w ON w.id <> a.id AND least(w.last_year, a.last_year) >= greatest(w.first_year, a.first_year) WHERE a.p_partkey % 50 = 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY overlap_years DESC, w.id) <= 15"""))
def j9_pairs(spark, sf):
    rows = works(spark, sf)
    anchors = rows.filter(F.col("work_id").cast("bigint") % 50 == 0)
    return R.overlap_period_pairs(rows, anchors, 15).select("anchor_id", "id", F.col("overlap_years").cast("int").alias("overlap_years"))


@query("j9_overlap_period", with_sql(WORKS_SQL, select="""
  SELECT w.id, least(w.last_year, a.last_year) - greatest(w.first_year, a.first_year) + 1 AS overlap_years FROM works w, (SELECT * FROM works WHERE id = 'work:11') a
  WHERE w.id <> a.id AND least(w.last_year, a.last_year) >= greatest(w.first_year, a.first_year) ORDER BY overlap_years DESC, w.id LIMIT 15"""))
def j9(spark, sf):
    return R.overlap_period_works(catalogue(spark, sf), "work:11").select("id", "overlap_years")


@query("q11_search_with_related", with_sql(
    GRAPH_SQL, _SAME_PUBLISHER.format(w=2), f"""
main AS (SELECT id FROM works WHERE {_RED} ORDER BY members DESC, p_partkey LIMIT 10),
other AS (SELECT id, jaccard FROM near ORDER BY same_author, round(jaccard, 9) DESC, overlap_years DESC, period_gap, id LIMIT 5),
merged AS (SELECT id, NULL::DOUBLE AS jaccard FROM main UNION ALL SELECT id, jaccard FROM other WHERE id NOT IN (SELECT id FROM main)),
big AS (SELECT m.id, jaccard, total_volumes FROM merged m JOIN works w ON w.id = m.id WHERE total_volumes >= 30)""",
    select="SELECT id, round(jaccard, 6) AS jaccard_similarity, total_volumes, row_number() OVER (ORDER BY total_volumes DESC, id) AS place FROM big"))
def q11(spark, sf):
    """Main hits and works of the same publisher, cut to long series and sorted by volumes."""
    from pyspark.sql import Window

    g = catalogue(spark, sf)
    main = S.simple_hits(g.of_type("work"), TERM, 10)
    found = R.search_with_same_publisher(main, g, "work:11", 2, related_limit=5, min_total_volumes=30, sort_total_volumes="desc")
    rows = found.select("id", "type", "members", "total_volumes", F.round("jaccard_similarity", 6).alias("jaccard_similarity"))
    # At most 15 rows reach this global order.
    place = F.row_number().over(Window.orderBy(*R.by_volumes(descending=True)))
    return top_rows(rows, 15, *R.by_volumes(descending=True)).select("id", "jaccard_similarity", "total_volumes", place.cast("bigint").alias("place"))


@query("q12_text_search", with_sql(WORKS_SQL, CREDITS_SQL, select="""
  SELECT id, title_name FROM works WHERE contains(title_name, '07') OR contains(english_name, '07')
     OR id IN (SELECT work_id FROM credits WHERE kind = 'creator' AND contains(name, '07')) ORDER BY members DESC, p_partkey LIMIT 40"""))
def q12(spark, sf):
    return S.text_search(works(spark, sf), credits(spark, sf), "07", 40).select("id", "title_name")


@query("q12_stored_search", with_sql(WORKS_SQL, CREDITS_SQL, select="""
  SELECT id, title_name FROM works WHERE contains(title_name, '007') OR contains(english_name, '007')
     OR id IN (SELECT work_id FROM credits WHERE kind = 'creator' AND contains(name, '007')) ORDER BY members DESC, p_partkey LIMIT 40"""))
def q12_stored(spark, sf):
    kept = stored_catalogue(spark, sf)
    return S.text_search(kept.works, kept.credits.rows.all(), "007", 40, kept.titles, kept.credits).select("id", "title_name")


@query("q12_text_search_credits", with_sql(WORKS_SQL, CREDITS_SQL, """
hits AS (SELECT id FROM works WHERE contains(title_name, '07') OR contains(english_name, '07')
         OR id IN (SELECT work_id FROM credits WHERE kind = 'creator' AND contains(name, '07')) ORDER BY members DESC, p_partkey LIMIT 40)""", select="""
  SELECT id, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE kind = 'creator'), '') AS creators,
         coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE kind = 'publisher'), '') AS publishers,
         coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE kind = 'magazine'), '') AS magazines
  FROM hits LEFT JOIN credits ON work_id = id GROUP BY id"""))
def q12_credits(spark, sf):
    names = credits(spark, sf)
    found = S.with_credits(S.text_search(works(spark, sf), names, "07", 40), names)
    return found.select("id", *[F.array_join(c, "|").alias(c) for c in ("creators", "publishers", "magazines")])


# Expansion and joins ---------------------------------------------------------------------------


@query("j1_one_hop", with_sql(GRAPH_SQL, _SEEDS, EXPAND_SQL, select="SELECT DISTINCT src, dst, type FROM touching"))
def j1(spark, sf):
    g = catalogue(spark, sf)
    return X.incident_edges(g, _seeds(g)).select("src", "dst", "type").distinct()


@query("j2_publisher_hop", with_sql(GRAPH_SQL, _SEEDS, EXPAND_SQL, select="SELECT DISTINCT src, dst, type FROM hop"))
def j2(spark, sf):
    g = catalogue(spark, sf)
    seeds = _seeds(g)
    return X.publisher_hop(g, X.incident_edges(g, seeds), seeds).select("src", "dst", "type")


@query("j3_typed_neighbours", with_sql(GRAPH_SQL, select="""
  SELECT DISTINCT w.id, w.label FROM works w JOIN edges e ON e.src = w.id WHERE e.type = 'PUBLISHED_IN' AND e.dst = 'magazine:4'"""))
def j3(spark, sf):
    return X.sources_of(catalogue(spark, sf), "PUBLISHED_IN", "magazine:4", "work").select("id", "label")


_NEW_EDGES = """
raw AS (SELECT DISTINCT 'work:' || l_partkey AS src, 'author:' || o_custkey AS dst, 'CREATED_BY' AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def customer_edges(spark, sf):
    """Parts linked to the customers who ordered them, most of whom are no authors."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.concat(F.lit("work:"), "l_partkey").alias("src"), F.concat(F.lit("author:"), "o_custkey").alias("dst"),
                       F.lit("CREATED_BY").alias("type")).distinct()


@query("j10_dangling_edges", with_sql(_NEW_EDGES, select="""
  SELECT src, dst FROM raw WHERE dst NOT IN (SELECT 'author:' || s_suppkey FROM supplier) OR src NOT IN (SELECT 'work:' || p_partkey FROM part)"""))
def j10(spark, sf):
    return dangling_edges(customer_edges(spark, sf), catalogue(spark, sf).nodes).select("src", "dst")


@query("j11_translated_labels", """
  SELECT p_type AS label, coalesce(t.v, p_type) AS translated, count(*) AS n FROM part
  LEFT JOIN (VALUES ('PROMO', '販促'), ('SMALL', '小型')) t(k, v) ON t.k = p_type GROUP BY ALL""")
def j11(spark, sf):
    from shelfgraph.functions.names import translate_by

    types = table(spark, sf, "part").select("p_type").distinct()
    ja = F.create_map(F.lit("PROMO"), F.lit("販促"), F.lit("SMALL"), F.lit("小型"))
    mapping = types.select(F.col("p_type").alias("key"), F.try_element_at(ja, "p_type").alias("value")).filter("value IS NOT NULL")
    rows = translate_by(table(spark, sf, "part"), "p_type", mapping, "translated")
    return rows.groupBy(F.col("p_type").alias("label"), "translated").agg(F.count("*").alias("n"))


@query("j12_work_by_id", with_sql(WORKS_SQL, select="SELECT id, title_name, members, total_volumes FROM works WHERE id = 'work:42'"))
def j12(spark, sf):
    return R.work_by_id(works(spark, sf), "work:42").select("id", "title_name", "members", "total_volumes")


# Filters ---------------------------------------------------------------------------------------


@query("f1_title_filter", with_sql(WORKS_SQL, select="""
  SELECT id, 'english' AS language FROM works WHERE contains(lower(title_name), 'ring') OR contains(lower(english_name), 'ring')
  UNION ALL SELECT id, 'japanese' FROM works WHERE contains(lower(japanese_name), 'dring') OR contains(lower(title_name), 'dring')"""))
def f1(spark, sf):
    w = titles(spark, sf)
    en = w.filter(Fi.title_matches("RING")).select("id", F.lit("english").alias("language"))
    return en.unionByName(w.filter(Fi.title_matches("dRing", Fi.JAPANESE)).select("id", F.lit("japanese").alias("language")))


@query("f2_node_types", with_sql(GRAPH_SQL, select="SELECT id, type FROM nodes WHERE type IN ('author', 'magazine')"))
def f2(spark, sf):
    return Fi.search_with_types(catalogue(spark, sf), "x", node_types=["author", "magazine"]).nodes.select("id", "type")


@query("f3_edge_types", with_sql(EDGES_SQL, select="SELECT src, dst, type FROM edges WHERE type IN ('PUBLISHED_BY', 'RELATED_TO')"))
def f3(spark, sf):
    return Fi.search_with_types(catalogue(spark, sf), "x", edge_types=["PUBLISHED_BY", "RELATED_TO"]).edge_rows()


@query("f3_blank_query", with_sql(EDGES_SQL, select="SELECT src, dst, type FROM edges WHERE false"))
def f3_blank(spark, sf):
    return Fi.search_with_types(catalogue(spark, sf), "  ").edge_rows()


@query("f4_content_filter_nodes", with_sql(GRAPH_SQL, select=f"SELECT id, type FROM nodes WHERE id NOT IN {_PROMO}"))
def f4_nodes(spark, sf):
    return Fi.drop_content(catalogue(spark, sf), "promo").nodes.select("id", "type")


@query("f4_content_filter_edges", with_sql(GRAPH_SQL, select=f"SELECT src, dst, type FROM edges WHERE src NOT IN {_PROMO} AND dst NOT IN {_PROMO}"))
def f4_edges(spark, sf):
    return Fi.drop_content(catalogue(spark, sf), "promo").edge_rows()


@query("f5_exact_genre", "SELECT 'work:' || p_partkey AS id FROM part WHERE p_type <> 'PROMO'")
def f5(spark, sf):
    return Fi.without_genre(titles(spark, sf), "PROMO").select("id")


@query("f6_min_volumes", with_sql(WORKS_SQL, select="SELECT id, total_volumes FROM works WHERE total_volumes >= 30"))
def f6(spark, sf):
    return Fi.min_volumes(works(spark, sf), 30).select("id", "total_volumes")


@query("f6_min_volumes_none", with_sql(WORKS_SQL, select="SELECT id, total_volumes FROM works"))
def f6_none(spark, sf):
    return Fi.min_volumes(works(spark, sf), 1_000_000).select("id", "total_volumes")


@query("f7_needing_covers", with_sql(WORKS_SQL, select="SELECT id, isbn FROM works WHERE isbn IS NOT NULL AND cover_image_url IS NULL ORDER BY id LIMIT 100"))
def f7(spark, sf):
    return top_rows(Fi.needing_covers(titles(spark, sf)), 100, F.col("id")).select("id", "isbn")


# Top-k -----------------------------------------------------------------------------------------


@query("w1_top_members", with_sql(WORKS_SQL, select="SELECT id, members FROM works ORDER BY members DESC, p_partkey LIMIT 50"))
def w1(spark, sf):
    return top_rows(works(spark, sf), 50, *S.by_members()).select("id", "members")


@query("w2_title_order", with_sql(WORKS_SQL, select="SELECT id, label FROM works ORDER BY lower(title_name), id LIMIT 50"))
def w2(spark, sf):
    return top_rows(titles(spark, sf), 50, *S.by_title()).select("id", "label")


@query("w3_reference_order", with_sql(WORKS_SQL, _scores("work:7"), select=f"""
  SELECT id, demo_score, themes_score, round(date_jaccard, 6) AS date_jaccard FROM scored ORDER BY {_RANK} LIMIT 50"""))
def w3(spark, sf):
    w = works(spark, sf)
    scored = R.with_reference_scores(w.filter(F.col("id") != "work:7"), R.work_by_id(w, "work:7"), AS_OF_YEAR)
    return top_rows(scored, 50, *R.by_reference()).select(
        "id", "demo_score", F.col("themes_score").cast("bigint").alias("themes_score"), F.round("date_jaccard", 6).alias("date_jaccard"))


@query("w4_topk_per_magazine", with_sql(GRAPH_SQL, _scores("work:7"), _per_magazine("true", _RANK, 5), select="SELECT magazine_id, id FROM picked"))
def w4(spark, sf):
    return R.works_per_magazine(catalogue(spark, sf), None, 5, "work:7", AS_OF_YEAR).select("magazine_id", "id")


@query("w5_volume_order", with_sql(GRAPH_SQL, select="""
  SELECT n.id, n.type FROM nodes n LEFT JOIN works w ON w.id = n.id
  ORDER BY n.type <> 'work', coalesce(nullif(total_volumes, 0), members, 0), n.id LIMIT 60"""))
def w5(spark, sf):
    return top_rows(catalogue(spark, sf).nodes, 60, *R.by_volumes(descending=False)).select("id", "type")


@query("w6_best_match", """
  SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_extendedprice, p_partkey) AS rn
    FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey) WHERE rn = 1""")
def w6(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    return first_per_key(rows, ["s_suppkey"], [F.col("l_extendedprice"), F.col("p_partkey")]).select("s_suppkey", "p_partkey")


@query("w7_first_per_key", "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_name")
def w7(spark, sf):
    return first_per_key(table(spark, sf, "part"), ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey", "p_type")


# Graph assembly --------------------------------------------------------------------------------


@query("r1_assemble_nodes", with_sql(GRAPH_SQL, _SEEDS, EXPAND_SQL, select="SELECT id, type, CASE WHEN id IN (SELECT id FROM seeds) THEN 'seed' ELSE 'rest' END AS part FROM nodes"))
def r1(spark, sf):
    g = catalogue(spark, sf)
    parts = [_seeds(g).withColumn("part", F.lit("seed")), g.nodes.withColumn("part", F.lit("rest"))]
    return X.assemble(parts, [g.edges.filter(F.lit(False))]).nodes.select("id", "type", "part")


@query("r2_merge_graphs", with_sql(GRAPH_SQL, select="""
  SELECT id, CASE WHEN type = 'author' THEN 'first' ELSE label END AS label FROM nodes"""))
def r2(spark, sf):
    g = catalogue(spark, sf)
    first = Graph(g.of_type("author").withColumn("label", F.lit("first")), g.edges_of("CREATED_BY"))
    return X.merge_graphs(first, g).nodes.select("id", "label")


@query("r2_merge_graph_edges", with_sql(GRAPH_SQL, select="""
  SELECT src, dst, type, type = 'CREATED_BY' AS from_first FROM edges"""))
def r2_edges(spark, sf):
    g = catalogue(spark, sf)
    first = Graph(g.of_type("author"), g.edges_of("CREATED_BY").withColumn("from_first", F.lit(True)))
    second = Graph(g.nodes, g.edges.withColumn("from_first", F.lit(False)))
    return X.merge_graphs(first, second).edges.select("src", "dst", "type", "from_first")


_ROWS = """
rows AS (
  SELECT id AS uri, title_name AS title, genre, first_published AS published_date, c.name AS creator_name, 'creator:' || c.name AS creator_uri
  FROM works JOIN (SELECT * FROM credits WHERE kind = 'creator') c ON c.work_id = id)"""


def _rows(spark, sf):
    return Tb.catalogue_rows(works(spark, sf), credits(spark, sf))


_R3 = _ROWS + """,
found AS (SELECT * FROM rows WHERE contains(title, 'red') ORDER BY uri, creator_uri LIMIT 200),
kept AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY title ORDER BY uri, creator_uri) = 1)"""


@query("r3_works_and_authors", with_sql(WORKS_SQL, CREDITS_SQL, _R3, select="""
  SELECT DISTINCT uri AS id, 'work' AS type, title AS label FROM kept UNION ALL SELECT DISTINCT creator_uri, 'author', creator_name FROM kept"""))
def r3(spark, sf):
    return Tb.works_and_authors(Tb.rows_by_title(catalogue_view(spark, sf), TERM, 200)).node_rows()


@query("r3_works_and_authors_edges", with_sql(WORKS_SQL, CREDITS_SQL, _R3, select="SELECT creator_uri || '-created-' || uri AS id FROM kept"))
def r3_edges(spark, sf):
    return Tb.works_and_authors(Tb.rows_by_title(catalogue_view(spark, sf), TERM, 200)).edges.select("id")


@query("r4_creator_works", with_sql(WORKS_SQL, CREDITS_SQL, _ROWS, """
found AS (SELECT * FROM rows WHERE contains(creator_name, '03') ORDER BY uri, creator_uri LIMIT 100)""", select="""
  SELECT DISTINCT uri AS id, 'work' AS type, title AS label FROM found UNION ALL SELECT DISTINCT creator_uri, 'author', creator_name FROM found"""))
def r4(spark, sf):
    return Tb.creator_and_works(Tb.rows_by_creator(_rows(spark, sf), "03", 100)).node_rows()


@query("r4_named_creator_edges", with_sql(WORKS_SQL, select=f"""
  SELECT 'author_' || sha256('red') AS src, id AS dst, 'created' AS type FROM (SELECT id FROM works WHERE {_RED} ORDER BY members DESC, p_partkey LIMIT 20)"""))
def r4_named(spark, sf):
    return Tb.named_creator_works(S.simple_hits(works(spark, sf), TERM, 20), TERM).edge_rows()


def _magazine_rows(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("mag:"), "n_nationkey").alias("uri"), F.col("n_name").alias("title"), F.lit("x").alias("genre"),
        F.concat(F.lit("pub:"), "r_regionkey").alias("publisher_uri"), F.col("r_name").alias("publisher_name"))


@query("r5_magazines_and_publishers", """
  SELECT 'mag:' || n_nationkey AS id, 'magazine' AS type, n_name AS label FROM nation
  UNION ALL SELECT 'pub:' || r_regionkey, 'publisher', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def r5(spark, sf):
    return Tb.magazines_and_publishers(_magazine_rows(spark, sf)).node_rows()


@query("r5_publishes_edges", "SELECT 'pub:' || n_regionkey AS src, 'mag:' || n_nationkey AS dst, 'publishes' AS type FROM nation")
def r5_edges(spark, sf):
    return Tb.magazines_and_publishers(_magazine_rows(spark, sf)).edge_rows()


_R6 = _ROWS + """,
placed AS (
  SELECT r.*, 'mag:' || m.name AS magazine_uri, m.name AS magazine_name FROM rows r JOIN (SELECT * FROM credits WHERE kind = 'magazine') m ON m.work_id = r.uri),
found AS (SELECT * FROM placed WHERE contains(magazine_name, 'NATION_1') AND substr(published_date, 1, 4) = '1997' ORDER BY uri, creator_uri, magazine_uri LIMIT 50)"""


def _placed_rows(spark, sf):
    m = credits(spark, sf).filter("kind = 'magazine'").select(
        F.col("work_id").alias("uri"), F.concat(F.lit("mag:"), "name").alias("magazine_uri"), F.col("name").alias("magazine_name"))
    return _rows(spark, sf).join(m, "uri")


@query("r6_magazine_relationships", with_sql(WORKS_SQL, CREDITS_SQL, _R6, select="""
  SELECT DISTINCT uri AS id, 'work' AS type, title AS label FROM found UNION ALL SELECT DISTINCT creator_uri, 'author', creator_name FROM found
  UNION ALL SELECT DISTINCT magazine_uri, 'magazine', magazine_name FROM found"""))
def r6(spark, sf):
    return Tb.magazine_relationships(Tb.rows_by_magazine(_placed_rows(spark, sf), "nation_1", "1997", 50)).node_rows()


@query("r6_magazine_relationship_edges", with_sql(WORKS_SQL, CREDITS_SQL, _R6, select="""
  SELECT DISTINCT creator_uri AS src, uri AS dst, 'created' AS type FROM found UNION ALL SELECT DISTINCT magazine_uri, uri, 'published' FROM found"""))
def r6_edges(spark, sf):
    return Tb.magazine_relationships(Tb.rows_by_magazine(_placed_rows(spark, sf), "nation_1", "1997", 50)).edge_rows()


@query("r7_typed_results", """
  SELECT id, CASE WHEN contains(id, 'author') THEN 'author' WHEN contains(id, 'work') THEN 'work' WHEN contains(id, 'periodical') THEN 'magazine' ELSE 'unknown' END AS type, label
  FROM (SELECT 'http://x/WORK/' || p_partkey AS uri, lower('http://x/WORK/' || p_partkey) AS k, p_name AS label FROM part
        UNION ALL SELECT 'http://x/author/' || s_suppkey, lower('http://x/author/' || s_suppkey), s_name FROM supplier
        UNION ALL SELECT 'http://x/periodical/' || n_nationkey, 'http://x/periodical/' || n_nationkey, n_name FROM nation
        UNION ALL SELECT 'http://x/other/' || r_regionkey, 'http://x/other/' || r_regionkey, r_name FROM region) t(id0, id, label)""".replace(
    "SELECT id, CASE", "SELECT id0 AS id, CASE"))
def r7(spark, sf):
    def part(name, prefix, key, label):
        return table(spark, sf, name).select(F.concat(F.lit("http://x/" + prefix + "/"), key).alias("uri"), F.col(label).alias("title"), F.lit("t").alias("type"))

    rows = part("part", "WORK", "p_partkey", "p_name").unionByName(part("supplier", "author", "s_suppkey", "s_name"))
    rows = rows.unionByName(part("nation", "periodical", "n_nationkey", "n_name")).unionByName(part("region", "other", "r_regionkey", "r_name"))
    return Tb.typed_results(rows).select("id", "type", "label")


_R8 = _ROWS + """,
pub AS (SELECT work_id, min(name) AS publisher FROM credits WHERE kind = 'publisher' GROUP BY work_id),
base AS (SELECT * FROM rows WHERE contains(title, 'red') ORDER BY uri, creator_uri LIMIT 40),
kept AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY title ORDER BY uri, creator_uri) = 1),
more AS (SELECT r.*, publisher FROM (SELECT * FROM rows WHERE contains(title, 'blue') ORDER BY uri, creator_uri LIMIT 40) r JOIN pub ON work_id = uri)"""


@query("r8_append_related", with_sql(WORKS_SQL, CREDITS_SQL, _R8, select="""
  SELECT DISTINCT uri AS id, 'work' AS type FROM kept UNION SELECT creator_uri, 'author' FROM kept
  UNION SELECT uri, 'work' FROM more UNION SELECT creator_uri, 'author' FROM more UNION SELECT 'publisher_' || sha256(publisher), 'publisher' FROM more"""))
def r8(spark, sf):
    rows = catalogue_view(spark, sf)
    base = Tb.works_and_authors(Tb.rows_by_title(rows, TERM, 40))
    return Tb.append_related(base, Tb.rows_by_title(rows, "blue", 40), "published_by").nodes.select("id", "type")


@query("r8_append_related_edges", with_sql(WORKS_SQL, CREDITS_SQL, _R8, select="""
  SELECT creator_uri || '-created-' || uri AS id FROM kept UNION SELECT creator_uri || '-created-' || uri FROM more
  UNION SELECT 'publisher_' || sha256(publisher) || '-publishes-' || uri FROM more"""))
def r8_edges(spark, sf):
    rows = catalogue_view(spark, sf)
    base = Tb.works_and_authors(Tb.rows_by_title(rows, TERM, 40))
    return Tb.append_related(base, Tb.rows_by_title(rows, "blue", 40), "published_by").edges.select("id")


@query("r9_search_with_related", with_sql(WORKS_SQL, CREDITS_SQL, _ROWS, """
base AS (SELECT * FROM rows WHERE contains(title, 'red') ORDER BY uri, creator_uri LIMIT 20),
kept AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY title ORDER BY uri, creator_uri) = 1),
overlapping AS (
  SELECT w.id FROM works w, (SELECT * FROM works WHERE id = 'work:11') a WHERE w.id <> a.id AND least(w.last_year, a.last_year) >= greatest(w.first_year, a.first_year)
  ORDER BY least(w.last_year, a.last_year) - greatest(w.first_year, a.first_year) DESC, w.id LIMIT 15),
more AS (SELECT * FROM rows WHERE uri IN (SELECT id FROM overlapping))""", select="""
  SELECT DISTINCT uri AS id, 'work' AS type FROM kept UNION SELECT creator_uri, 'author' FROM kept UNION SELECT uri, 'work' FROM more UNION SELECT creator_uri, 'author' FROM more"""))
def r9(spark, sf):
    rows = catalogue_view(spark, sf)
    overlapping = rows.rows_of(R.overlap_period_works(catalogue(spark, sf), "work:11").select("id").persist())
    return Tb.search_with_related(rows, TERM, 20, overlapping, ["blue"], per_title=2, when_at_most=2).nodes.select("id", "type")


@query("r9_search_with_related_edges", with_sql(WORKS_SQL, CREDITS_SQL, _ROWS, """
base AS (SELECT * FROM rows WHERE contains(title, 'red') ORDER BY uri, creator_uri LIMIT 20),
kept AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY title ORDER BY uri, creator_uri) = 1),
overlapping AS (
  SELECT w.id FROM works w, (SELECT * FROM works WHERE id = 'work:11') a WHERE w.id <> a.id AND least(w.last_year, a.last_year) >= greatest(w.first_year, a.first_year)
  ORDER BY least(w.last_year, a.last_year) - greatest(w.first_year, a.first_year) DESC, w.id LIMIT 15),
more AS (SELECT * FROM rows WHERE uri IN (SELECT id FROM overlapping))""", select="""
  SELECT creator_uri AS src, uri AS dst, 'created' AS type FROM kept UNION SELECT creator_uri, uri, 'created' FROM more"""))
def r9_edges(spark, sf):
    rows = catalogue_view(spark, sf)
    overlapping = rows.rows_of(R.overlap_period_works(catalogue(spark, sf), "work:11").select("id").persist())
    return Tb.search_with_related(rows, TERM, 20, overlapping).edge_rows()


@query("r9_search_with_fallback", with_sql(WORKS_SQL, CREDITS_SQL, _ROWS, """
more AS (
  (SELECT * FROM rows WHERE contains(title, 'blue') ORDER BY uri, creator_uri LIMIT 2)
  UNION ALL (SELECT * FROM rows WHERE contains(title, 'ring') ORDER BY uri, creator_uri LIMIT 2))""", select="""
  SELECT DISTINCT uri AS id, 'work' AS type FROM more UNION SELECT creator_uri, 'author' FROM more"""))
def r9_fallback(spark, sf):
    rows = catalogue_view(spark, sf)
    return Tb.search_with_related(rows, "nothing", 20, rows.rows().filter(F.lit(False)), ["blue", "ring"], per_title=2, when_at_most=2).nodes.select("id", "type")


@query("r11_related_graphs_nodes", with_sql(
    GRAPH_SQL, _scores("work:7"), f"""
a AS (SELECT w.id FROM works w JOIN edges e ON e.src = w.id WHERE e.type = 'CREATED_BY' AND e.dst = 'author:3' ORDER BY lower(title_name), w.id LIMIT 5),
m AS (SELECT s.id FROM scored s JOIN edges e ON e.src = s.id WHERE e.type = 'PUBLISHED_IN' AND e.dst = 'magazine:4' ORDER BY {_RANK.replace('id', 's.id')} LIMIT 5),
p AS (SELECT n.id FROM nodes n JOIN edges e ON e.src = n.id WHERE e.type = 'PUBLISHED_BY' AND e.dst = 'publisher:2' ORDER BY lower(label), n.id LIMIT 3)""",
    select="""SELECT id, 'author_graph' AS part FROM a UNION ALL SELECT DISTINCT 'author:3', 'author_graph' FROM a UNION ALL SELECT id, 'magazine_graph' FROM m
      UNION ALL SELECT DISTINCT 'magazine:4', 'magazine_graph' FROM m UNION ALL SELECT id, 'publisher_graph' FROM p UNION ALL SELECT DISTINCT 'publisher:2', 'publisher_graph' FROM p"""))
def r11(spark, sf):
    parts = R.related_graphs(catalogue(spark, sf), "author:3", "magazine:4", "publisher:2", reference_id="work:7", as_of_year=AS_OF_YEAR)
    return R.tag_parts(parts)[0].select("id", "part")


@query("r11_related_graphs_edges", with_sql(
    GRAPH_SQL, _scores("work:7"), f"""
a AS (SELECT w.id FROM works w JOIN edges e ON e.src = w.id WHERE e.type = 'CREATED_BY' AND e.dst = 'author:3' ORDER BY lower(title_name), w.id LIMIT 5),
m AS (SELECT s.id FROM scored s JOIN edges e ON e.src = s.id WHERE e.type = 'PUBLISHED_IN' AND e.dst = 'magazine:4' ORDER BY {_RANK.replace('id', 's.id')} LIMIT 5),
p AS (SELECT n.id FROM nodes n JOIN edges e ON e.src = n.id WHERE e.type = 'PUBLISHED_BY' AND e.dst = 'publisher:2' ORDER BY lower(label), n.id LIMIT 3)""",
    select="""SELECT id AS src, 'author:3' AS dst, 'CREATED_BY' AS type, 'author_graph' AS part FROM a
      UNION ALL SELECT id, 'magazine:4', 'PUBLISHED_IN', 'magazine_graph' FROM m UNION ALL SELECT id, 'publisher:2', 'PUBLISHED_BY', 'publisher_graph' FROM p"""))
def r11_edges(spark, sf):
    parts = R.related_graphs(catalogue(spark, sf), "author:3", "magazine:4", "publisher:2", reference_id="work:7", as_of_year=AS_OF_YEAR)
    return R.tag_parts(parts)[1].select("src", "dst", "type", "part")


@query("r12_all_magazines_edges", with_sql(
    GRAPH_SQL, "scored AS (SELECT id, title_name FROM works)", _per_magazine("true", "lower(title_name), id", 3),
    select="SELECT id AS src, magazine_id AS dst, 'PUBLISHED_IN' AS type FROM picked"))
def r12_edges(spark, sf):
    g = catalogue(spark, sf)
    best = R.works_per_magazine(g, None, 3).select(F.col("edge_id").alias("id"))
    return g.edges_of("PUBLISHED_IN").join(best, "id", "left_semi").select("src", "dst", "type")


@query("r12_all_magazines_flattened", with_sql(
    GRAPH_SQL, "scored AS (SELECT id, title_name FROM works)", _per_magazine("true", "lower(title_name), id", 3),
    select="SELECT id, type FROM nodes WHERE type = 'magazine' OR id IN (SELECT id FROM picked)"))
def r12(spark, sf):
    g = catalogue(spark, sf)
    best = R.works_per_magazine(g, None, 3)
    flat = g.of_type("work").join(best.select("id").distinct(), "id", "left_semi")
    return flat.unionByName(g.of_type("magazine")).select("id", "type")
