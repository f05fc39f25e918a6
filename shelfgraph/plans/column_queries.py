"""Column functions over names, titles, cells and nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgraph.functions import names as N, nodes as Nd, scoring as Sc, titles as Ti
from shelfgraph.operators import ttl
from shelfgraph.operators.search import term_edits
from shelfgraph.plans import source_binding as B
from shelfgraph.plans.binding import AS_OF_YEAR, GRAPH_SQL, WORKS_SQL, catalogue, with_sql, works
from shelfgraph.plans.registry import query, table
from shelfgraph.sources import api_json, cells


def _supplier(spark, sf):
    return table(spark, sf, "supplier")


def _part(spark, sf):
    return table(spark, sf, "part")


@query("n1_manga_records", """
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS mal_id, p_name AS title_name, upper(p_name) AS japanese_name, lower(p_type) AS english_name,
         p_brand AS synonymns, p_type AS genres, p_name AS authors, p_name || '/Art' AS author_roles, p_brand AS serialization,
         CASE WHEN p_size > 10 THEN 'l/' ELSE 'm/' END || p_partkey AS main_picture, p_retailprice AS score, p_size AS volumes,
         (p_partkey + 1) || ':' || CASE WHEN p_size > 25 THEN 'Sequel' ELSE 'sequel' END AS related,
         CASE WHEN p_size > 40 THEN CAST(p_size AS BIGINT) END AS ranking_position, 'https://myanimelist.net/manga/' || p_partkey AS source_link
  FROM part""")
def n1(spark, sf):
    w = api_json.manga_works(api_json.parse_records(B.api_records(spark, sf)))
    pairs = lambda c, a, b, sep: F.array_join(F.transform(c, lambda r: F.concat_ws(sep, r[a].cast("string"), r[b])), "|")
    return w.select("id", "mal_id", "title_name", "japanese_name", "english_name", F.array_join("synonymns", "|").alias("synonymns"),
                    F.array_join("genres", "|").alias("genres"), F.array_join("authors", "|").alias("authors"),
                    pairs("author_roles", "name", "role", "/").alias("author_roles"),
                    F.array_join("serialization", "|").alias("serialization"), "main_picture", "score", "volumes",
                    pairs("related_manga", "id", "relation_type", ":").alias("related"), "ranking_position", "source_link")


@query("n2_anime_records", """
  SELECT 'anime_' || p_partkey AS id, p_partkey AS mal_id, p_size AS episodes, lower(p_type) || ' 2001' AS start_season, p_type AS broadcast,
         p_brand AS studios, p_type AS genres FROM part""")
def n2(spark, sf):
    w = api_json.anime_works(api_json.parse_records(B.api_records(spark, sf)))
    return w.select("id", "mal_id", "episodes", "start_season", "broadcast", F.array_join("studios", "|").alias("studios"),
                    F.array_join("genres", "|").alias("genres"))


@query("n3_node_properties", "SELECT CAST(p_partkey AS VARCHAR) AS id, 34 AS columns, p_name AS title_name FROM part")
def n3(spark, sf):
    w = api_json.node_properties(api_json.manga_works(api_json.parse_records(B.api_records(spark, sf))))
    return w.select("id", F.lit(len(w.columns) + len(api_json.LINKS)).alias("columns"), "title_name")


def _entries(spark, sf):
    """Part rows as records whose magazine and author entries take each of the three shapes."""
    text = F.col("p_brand")
    shape = F.when(F.col("p_size") > 30, F.concat(F.lit('"'), text, F.lit('"'))).when(
        F.col("p_size") > 15, F.concat(F.lit('{"node":{"id":'), "p_partkey", F.lit(',"name":"'), text, F.lit('"}}'))
    ).otherwise(F.concat(F.lit('{"id":'), "p_partkey", F.lit(',"name":"'), text, F.lit('"}')))
    people = F.when(F.col("p_size") > 30, F.concat(F.lit('" '), text, F.lit('"'))).when(
        F.col("p_size") > 15, F.concat(F.lit('{"node":{"id":'), "p_partkey", F.lit(',"first_name":"A","last_name":"'), text, F.lit('"},"role":"Art"}'))
    ).otherwise(F.concat(F.lit('{"last_name":"'), text, F.lit('","role":"Story"},{"role":"none"}')))
    record = F.concat(F.lit('{"serialization":['), shape, F.lit('],"authors":['), people, F.lit("]}"))
    return _part(spark, sf).select("p_partkey", F.parse_json(record).alias("item"))


@query("n4_serialization_entries", "SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE p_partkey END AS id, p_brand AS name FROM part")
def n4(spark, sf):
    return _entries(spark, sf).select("p_partkey", F.inline(api_json.serialization_entries("item")))


@query("n5_author_entries", """
  SELECT p_partkey, CASE WHEN p_size > 15 AND p_size <= 30 THEN p_partkey END AS id,
         CASE WHEN p_size > 15 AND p_size <= 30 THEN 'A ' ELSE '' END || p_brand AS name,
         CASE WHEN p_size > 15 AND p_size <= 30 THEN 'A' ELSE '' END AS first_name,
         CASE WHEN p_size > 30 THEN '' ELSE p_brand END AS last_name,
         CASE WHEN p_size > 30 THEN '' WHEN p_size > 15 THEN 'Art' ELSE 'Story' END AS role FROM part""")
def n5(spark, sf):
    return _entries(spark, sf).select("p_partkey", F.inline(api_json.author_entries("item")))


@query("n6_clean_entries", "SELECT p_partkey, p_brand || ' x|' || p_type AS entries FROM part")
def n6(spark, sf):
    raw = F.array(F.concat(F.lit("  "), "p_brand", F.lit("   x ")), F.lit(" N/A"), F.col("p_type"), F.concat("p_brand", F.lit(" x")), F.lit(None).cast("string"), F.lit(""))
    return _part(spark, sf).select("p_partkey", F.array_join(cells.clean_entries(raw), "|").alias("entries"))


@query("n7_creator_names", "SELECT s_suppkey, s_name AS name FROM supplier")
def n7(spark, sf):
    return _supplier(spark, sf).select("s_suppkey", N.normalize_creator(F.concat(F.lit("　[[著]] "), "s_name", F.lit("[x]"))).alias("name"))


@query("n8_publisher_names", "SELECT s_suppkey, s_name AS name FROM supplier")
def n8(spark, sf):
    return _supplier(spark, sf).select("s_suppkey", N.normalize_publisher(F.concat("s_name", F.lit("（発売）　∥　ヨミ"))).alias("name"))


@query("n9_split_creators", """
  SELECT s_suppkey, 'comma' AS kind, unnest(['[原作]' || s_name, '[原作]x']) AS creator FROM supplier
  UNION ALL SELECT s_suppkey, 'dot', unnest(['a' || s_suppkey, 'b']) FROM supplier WHERE length('a' || s_suppkey) <= 8
  UNION ALL SELECT s_suppkey, 'company', 'a' || s_suppkey || '・b社' FROM supplier""")
def n9(spark, sf):
    s, a = F.col("s_name"), F.concat(F.lit("a"), "s_suppkey")
    cases = F.array(
        F.struct(F.lit("comma").alias("kind"), F.concat(F.lit("[原作]"), s, F.lit("、 x, ")).alias("raw")),
        F.struct(F.lit("dot").alias("kind"), F.concat(a, F.lit("・b")).alias("raw")),
        F.struct(F.lit("company").alias("kind"), F.concat(a, F.lit("・b社")).alias("raw")))
    rows = _supplier(spark, sf).select("s_suppkey", F.inline(cases))
    return rows.select("s_suppkey", "kind", F.explode(N.split_creators("raw")).alias("creator"))


@query("n10_split_and_normalize", "SELECT s_suppkey, unnest([s_name, 'x y']) AS creator FROM supplier")
def n10(spark, sf):
    raw = F.concat(F.lit("[作画]"), "s_name", F.lit(", x y"))
    return _supplier(spark, sf).select("s_suppkey", F.explode(N.split_and_normalize_creators(raw)).alias("creator"))


@query("n11_entity_ids", "SELECT s_suppkey, 'author_' || sha256(s_name) AS id FROM supplier")
def n11(spark, sf):
    return _supplier(spark, sf).select("s_suppkey", N.entity_id("s_name", "author").alias("id"))


@query("n12_editorial_names", "SELECT s_suppkey, s_acctbal < 0 AS editorial FROM supplier")
def n12(spark, sf):
    raw = F.when(F.col("s_acctbal") < 0, F.concat("s_name", F.lit("・編集部"))).otherwise(F.col("s_name"))
    return _supplier(spark, sf).select("s_suppkey", N.is_editorial(raw).alias("editorial"))


@query("n13_author_names", "SELECT s_suppkey, s_name AS name FROM supplier")
def n13(spark, sf):
    return _supplier(spark, sf).select("s_suppkey", N.author_name(F.concat(F.lit("[著]"), "s_name", F.lit("・かんしゅう"))).alias("name"))


@query("n14_canonical_keys", "SELECT s_suppkey, 'おだ ' || lower(s_name) AS key, 'よみ' AS reading FROM supplier")
def n14(spark, sf):
    named = _supplier(spark, sf).withColumn("raw", F.concat(F.lit("オダ "), "s_name", F.lit("（監修）"))).withColumn("kanji", F.concat(F.lit("漢"), "s_name"))
    readings = _supplier(spark, sf).select(F.concat(F.lit("漢"), "s_name").alias("surface"), F.lit("ヨミ").alias("reading"))
    keyed = N.with_canonical_key(N.with_canonical_key(named, "raw"), "kanji", readings, out="reading")
    return keyed.select("s_suppkey", "key", "reading")


@query("n15_script_priority", """
  SELECT s_suppkey, CASE WHEN s_nationkey < 6 THEN 4 WHEN s_nationkey < 12 THEN 3 WHEN s_nationkey < 18 THEN 2 ELSE 1 END AS priority FROM supplier""")
def n15(spark, sf):
    nation = F.col("s_nationkey")
    name = F.when(nation < 6, F.concat(F.lit("漢字"), "s_name")).when(nation < 12, F.col("s_name")).when(nation < 18, "カタカナ").otherwise("ひらがな 1")
    return _supplier(spark, sf).select("s_suppkey", N.script_priority(name).alias("priority"))


@query("n16_role_scores", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 8 ELSE 3 END AS score FROM supplier")
def n16(spark, sf):
    raw = F.concat(F.when(F.col("s_acctbal") < 0, "[原作]").otherwise("[監修]"), "s_name")
    return _supplier(spark, sf).select("s_suppkey", N.role_aware_score(raw).alias("score"))


@query("n17_first_appearance", "SELECT p_partkey, p_brand || '|' || p_name AS magazines FROM part")
def n17(spark, sf):
    raw = F.concat(F.lit("「no」初出：「"), "p_brand", F.lit("」1号「a」「 "), "p_name", F.lit(" 」"))
    return _part(spark, sf).select("p_partkey", F.array_join(N.first_appearance_magazines(raw), "|").alias("magazines"))


_BRAND_SQL = "SELECT DISTINCT p_brand, n_name FROM part JOIN nation ON CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) = n_nationkey"


@query("n18_brand_magazines", f"""
  SELECT 'series:' || p_partkey AS series_id, coalesce(n_name, p.p_brand) AS magazine FROM part p LEFT JOIN ({_BRAND_SQL}) b ON b.p_brand = p.p_brand""")
def n18(spark, sf):
    from shelfgraph.operators.build import series_brands, series_rows

    return series_brands(series_rows(B.typed_series(spark, sf)), B.brand_lookup(spark, sf))


@query("n19_brand_passthrough", f"""
  SELECT p_partkey, coalesce(n_name, p.p_brand) AS magazine FROM part p LEFT JOIN ({_BRAND_SQL}) b ON b.p_brand = p.p_brand""")
def n19(spark, sf):
    return N.translate_by(_part(spark, sf), "p_brand", B.brand_lookup(spark, sf), "magazine").select("p_partkey", "magazine")


@query("n20_work_titles", """
  SELECT l_orderkey, l_linenumber, l_partkey, p_name AS title, upper(p_name) AS key FROM lineitem JOIN part ON l_partkey = p_partkey""")
def n20(spark, sf):
    rows = table(spark, sf, "lineitem").join(_part(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    full = F.concat_ws(" ", "p_name", F.col("l_linenumber").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", Ti.work_title(full, "l_linenumber").alias("title"), Ti.work_key(full, "l_linenumber").alias("key"))


_SUFFIXES = ["", " 第3巻", " (12)", " vol. 4", " VOLUME 5", " 巻6", " その7", " 8", " 第3巻 (2)", " = Alias 9"]
_SUFFIX_LIST = "[" + ", ".join(f"'{s}'" for s in _SUFFIXES) + "]"


@query("n21_base_titles", f"SELECT p_partkey, p_name || s AS title, p_name AS base FROM part, (SELECT unnest({_SUFFIX_LIST}) AS s)")
def n21(spark, sf):
    titles = F.explode(F.transform(F.array(*[F.lit(s) for s in _SUFFIXES]), lambda s: F.concat(F.col("p_name"), s)))
    return _part(spark, sf).select("p_partkey", titles.alias("title")).withColumn("base", Ti.base_title("title"))


@query("n22_volume_numbers", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE l_returnflag WHEN 'N' THEN NULL ELSE l_linenumber END AS volume FROM lineitem""")
def n22(spark, sf):
    flag, number = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    title = F.when(flag == "A", F.concat(F.lit("x "), F.translate(number, "123456789", "１２３４５６７８９"))).otherwise("x")
    field = F.when(flag == "R", F.concat(F.lit(" "), number)).when(flag == "A", "extra")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", Ti.volume_number(title, field).alias("volume"))


@query("n23_spin_offs", "SELECT p_partkey, p_size > 25 OR p_size <= 5 AS spin_off FROM part")
def n23(spark, sf):
    raw = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" 外伝"))).when(F.col("p_size") <= 5, F.concat("p_name", F.lit(" ANOTHER"))).otherwise(F.col("p_name"))
    return _part(spark, sf).select("p_partkey", Ti.is_spin_off(raw).alias("spin_off"))


@query("n24_linkage_titles", "SELECT p_partkey, replace(p_name, ' ', '') || 'Z' AS title FROM part")
def n24(spark, sf):
    raw = F.concat(F.lit(" 〜"), "p_name", F.lit("！ -（外 伝) Z?"))
    return _part(spark, sf).select("p_partkey", Ti.linkage_title(raw).alias("title"))


_DATED = """
dated AS (
  SELECT p_partkey, p_size, first_year, last_year,
         CASE WHEN p_size <= 10 THEN strftime(t0, '%b %d, %Y') || ' to ?' WHEN p_size <= 15 THEN CAST(first_year AS VARCHAR) ELSE publishing_date END AS pub
  FROM works JOIN part USING (p_partkey) LEFT JOIN stats ON l_partkey = p_partkey)"""


@query("n25_period_years", with_sql(WORKS_SQL, _DATED, select="""
  SELECT p_partkey, CASE WHEN p_size > 10 AND p_size <= 15 THEN NULL ELSE first_year END AS start_year,
         CASE WHEN p_size <= 15 OR pub IS NULL THEN 2001 ELSE last_year END AS end_year FROM dated"""))
def n25(spark, sf):
    w = works(spark, sf).join(_part(spark, sf).select(F.col("p_partkey").cast("string").alias("work_id"), "p_partkey", "p_size"), "work_id")
    raw = F.when(F.col("p_size") <= 10, F.concat(F.substring_index("publishing_date", " to ", 1), F.lit(" to ?"))).when(
        F.col("p_size") <= 15, F.col("first_year").cast("string")).otherwise(F.col("publishing_date"))
    return w.select("p_partkey", Sc.start_year(raw).alias("start_year"), Sc.end_year(raw, AS_OF_YEAR).alias("end_year"))


@query("n26_period_jaccard", with_sql(WORKS_SQL, select="""
  SELECT p_partkey, CASE WHEN first_year IS NULL OR least(last_year, 1999) < greatest(first_year, 1997) THEN 0.0
    ELSE round((least(last_year, 1999) - greatest(first_year, 1997) + 1)::DOUBLE
         / (3 + (last_year - first_year + 1) - (least(last_year, 1999) - greatest(first_year, 1997) + 1)), 9) END AS jaccard FROM works"""))
def n26(spark, sf):
    j = Sc.period_jaccard(F.lit(1997), F.lit(1999), "first_year", "last_year")
    return works(spark, sf).select(F.col("work_id").cast("bigint").alias("p_partkey"), F.round(j, 9).alias("jaccard"))


@query("n27_audience_scores", """
  SELECT p_partkey, CASE WHEN p_brand = 'Brand#3' THEN 2 ELSE 0 END AS demo, CASE WHEN p_brand IN ('Brand#3') THEN 1 ELSE 0 END AS partial,
         len(list_filter(['red', 'ring', 'red'], lambda x: list_contains(string_split(p_name, ' '), x))) AS themes,
         round(len(list_filter(['red', 'ring', 'red'], lambda x: list_contains(string_split(p_name, ' '), x))) / 3.0, 9) AS ratio FROM part""")
def n27(spark, sf):
    brand, themes = F.array("p_brand"), F.split("p_name", " ")
    ref = F.array(F.lit("red"), F.lit("ring"), F.lit("red"))
    two = F.array(F.lit("Brand#3"), F.lit("other"))
    return _part(spark, sf).select(
        F.col("p_partkey"), Sc.demographic_score(F.array(F.lit("Brand#3")), brand).alias("demo"), Sc.demographic_score(two, brand).alias("partial"),
        Sc.themes_overlap(ref, themes).cast("bigint").alias("themes"), F.round(Sc.themes_ratio(ref, themes), 9).alias("ratio"))


@query("n28_node_types", """
  SELECT id, split_part(id, ':', 1) AS type FROM (SELECT 'work:' || p_partkey AS id FROM part UNION ALL SELECT 'author:' || s_suppkey FROM supplier
    UNION ALL SELECT 'magazine:' || n_nationkey FROM nation UNION ALL SELECT 'publisher:' || r_regionkey FROM region)""")
def n28(spark, sf):
    n = catalogue(spark, sf).nodes
    labels = F.array(F.lit("Thing"), F.initcap("type"))
    return n.select("id", Nd.infer_type(labels).alias("type"))


@query("n29_node_labels", """
  SELECT 'work:' || p_partkey AS id, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 15 THEN lower(p_type) WHEN p_size > 5 THEN CAST(p_partkey AS VARCHAR) ELSE 'Work' END AS label FROM part
  UNION ALL SELECT 'author:' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 'Author' ELSE s_name END FROM supplier""")
def n29(spark, sf):
    size = F.col("p_size")
    w = _part(spark, sf).select(
        F.concat(F.lit("work:"), "p_partkey").alias("id"), F.lit("work").alias("type"),
        F.when(size > 25, F.col("p_name")).otherwise("  ").alias("title_name"), F.when(size > 15, F.lower("p_type")).alias("english_name"),
        F.when(size > 5, F.col("p_partkey").cast("string")).alias("key"))
    a = _supplier(spark, sf).select(
        F.concat(F.lit("author:"), "s_suppkey").alias("id"), F.lit("author").alias("type"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("name"))
    both = w.unionByName(a, allowMissingColumns=True)
    return both.select("id", Nd.derive_label(F.col("type"), title_name="title_name", english_name="english_name", id="key", name="name").alias("label"))


@query("n30_content_test", "SELECT p_partkey, p_type = 'PROMO' AS listed, p_type = 'PROMO' AS text, p_type = 'PROMO' AS mapped FROM part")
def n30(spark, sf):
    none = F.array().cast("array<string>")
    return _part(spark, sf).select(
        "p_partkey", Nd.mentions("Promo", F.array("p_type", F.lit(None).cast("string")), F.lit("-")).alias("listed"),
        Nd.mentions("rom", none, F.lower("p_type")).alias("text"), Nd.mentions_in_map("PROM", F.create_map(F.lit("a"), F.col("p_type"))).alias("mapped"))


@query("n31_output_works", with_sql(WORKS_SQL, select="""
  SELECT id, label, title_name AS title, CASE WHEN total_volumes > 25 THEN '1' ELSE '' END AS volume, total_volumes > 25 AS is_series,
         1 AS work_count, total_volumes, coalesce(isbn, '') AS isbn, media_type AS publishers, 'neo4j' AS source,
         CASE WHEN total_volumes > 25 THEN coalesce(first_published, '') END AS date_range FROM works"""))
def n31(spark, sf):
    w = works(spark, sf).select(
        "id", "label", F.col("title_name").alias("title"), "isbn", "total_volumes", F.col("first_published").alias("published_date"),
        (F.col("total_volumes") > 25).alias("is_series"),
        F.array("media_type", F.concat("media_type", F.lit("（発売）")), F.lit("")).alias("publishers"))
    out = Nd.output_works(w)
    return out.select("id", "label", "title", "volume", "is_series", "work_count", "total_volumes", "isbn",
                      F.array_join("publishers", "|").alias("publishers"), "source", "date_range")


@query("n31_output_nodes", with_sql(GRAPH_SQL, select="""
  SELECT id, label, type, '{"source":"neo4j","name":"' || label || '"}' AS properties FROM nodes WHERE type IN ('author', 'magazine', 'publisher')
  UNION ALL SELECT 'publication:' || p_partkey, p_name, 'publication',
    '{"source":"neo4j","title":"' || p_name || '","publication_date":"","genre":"' || p_type || '","creators":["' || p_brand || '"],"magazines":[]}' FROM part"""))
def n31_nodes(spark, sf):
    publications = _part(spark, sf).select(
        F.concat(F.lit("publication:"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("publication").alias("type"),
        F.col("p_type").alias("genre"), F.array("p_brand").alias("creators"))
    rows = catalogue(spark, sf).nodes.select("id", "label", "type").unionByName(publications, allowMissingColumns=True)
    return Nd.output_nodes(rows)


@query("n31_output_edges", with_sql(GRAPH_SQL, select="""
  SELECT src || '-' || type || '-' || dst AS id, src AS source, dst AS target, type, '{"source":"neo4j"}' AS properties FROM edges"""))
def n31_edges(spark, sf):
    return Nd.output_edges(catalogue(spark, sf).edges.withColumn("id", F.lit(None).cast("string")))


@query("n32_strip_embeddings", "SELECT vec_id, label FROM embeddings")
def n32(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "embedding_title_en")
    return Nd.strip_embeddings(e)


@query("n33_publication_year", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate, '%Y') END AS year FROM orders")
def n33(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit("c. 1999")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, sf, "orders").select("o_orderkey", Nd.publication_year(raw).alias("year"))


@query("n34_placeholder_covers", """
  SELECT p_partkey, '/static/images/placeholders/' || CASE WHEN p_type = 'PROMO' THEN 'manga' WHEN p_size > 40 THEN 'shueisha' WHEN p_size > 30 THEN 'kodansha'
    WHEN p_size > 20 THEN 'shogakukan' ELSE 'default' END || '-cover.png' AS cover FROM part""")
def n34(spark, sf):
    size = F.col("p_size")
    pub = F.when(size > 40, "株式会社集英社").when(size > 30, "講談社").when(size > 20, "小学館")
    return _part(spark, sf).select("p_partkey", Nd.placeholder_cover(F.when(F.col("p_type") == "PROMO", "マンガ単行本"), pub).alias("cover"))


# Cover cache of the events: newest row per user, an error being a negative entry.
AS_OF = 1706659200.0  # 2024-01-31
TTL = 86400.0
_CACHE = """
cache AS (
  SELECT CAST(user_id AS VARCHAR) AS key, max(epoch(ts)) AS ts,
         arg_max(event_id, row(ts, event_id)) AS last_id, arg_max(event_type, row(ts, event_id)) AS last_type
  FROM events GROUP BY user_id),
covers AS (SELECT key, ts, CASE WHEN last_type <> 'error' THEN 'http://c/' || last_id END AS cover_url FROM cache)"""


def cover_entries(spark, sf):
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("http://c/"), "event_id"))
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("user_id").cast("string").alias("isbn"), F.lit(None).cast("string").alias("title"),
        url.alias("cover_url"), F.col("ts").cast("timestamp").cast("double").alias("ts"))


def cover_cache(spark, sf):
    entries = cover_entries(spark, sf)
    return ttl.put(entries.filter(F.lit(False)), entries)


@query("n35_cover_resolution", with_sql(_CACHE, select="""
  SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'stored/' || p_partkey WHEN u.value > 20 THEN cover_url
           ELSE '/static/images/placeholders/default-cover.png' END AS cover_url,
         CASE WHEN p_type = 'PROMO' THEN 'stored' WHEN u.value > 20 THEN 'api' ELSE 'placeholder' END AS source,
         p_type = 'PROMO' OR coalesce(u.value > 20, false) AS has_real_cover
  FROM part LEFT JOIN covers ON key = CAST(p_partkey AS VARCHAR) AND 1706659200.0 - ts <= 86400.0
  LEFT JOIN events u ON cover_url = 'http://c/' || u.event_id"""))
def n35(spark, sf):
    w = _part(spark, sf).select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("isbn"), F.col("p_type").alias("genre"), F.lit("x").alias("publisher"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("stored/"), "p_partkey")).alias("cover_image_url"))
    status = table(spark, sf, "events").select(F.concat(F.lit("http://c/"), "event_id").alias("url"), (F.col("value") > 20).alias("ok"))
    return ttl.resolve_covers(w, cover_cache(spark, sf), status, AS_OF, TTL)


@query("n36_properties_json", """
  SELECT n_nationkey, '{"name":"' || n_name || '"' || CASE WHEN n_regionkey > 2 THEN ',"region":' || n_regionkey ELSE '' END || '}' AS properties FROM nation""")
def n36(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", Nd.properties_json(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("region")).alias("properties"))


@query("n37_split_cells", "SELECT p_partkey, p_brand || '|' || p_type AS entries FROM part")
def n37(spark, sf):
    return _part(spark, sf).select("p_partkey", F.array_join(cells.split_cell(F.concat("p_brand", F.lit("; "), "p_type", F.lit(", ,"), "p_brand")), "|").alias("entries"))


@query("n38_query_terms", """
  SELECT p_partkey, string_agg(DISTINCT w || ':' || (w = string_split(p_name, ' ')[-1])::INT, ' ' ORDER BY w || ':' || (w = string_split(p_name, ' ')[-1])::INT) AS terms
  FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_partkey""")
def n38(spark, sf):
    """Every part name as a search term, in odd case and with marks that are not searched."""
    term = F.concat(F.lit(" ("), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(")! "))
    shown = F.transform(term_edits(term), lambda t: F.concat_ws(":", t["token"], t["edits"]))
    return _part(spark, sf).select("p_partkey", F.array_join(F.array_sort(shown), " ").alias("terms"))


@query("n39_title_similarity", """
  SELECT p_partkey, round(1 - levenshtein(lower(p_name), 'red ring') / greatest(length(p_name), 8)::DOUBLE, 9) AS similarity FROM part""")
def n39(spark, sf):
    return _part(spark, sf).select("p_partkey", F.round(Ti.levenshtein_similarity(F.lower("p_name"), F.lit("red ring")), 9).alias("similarity"))


# Cover cache ---------------------------------------------------------------------------------


@query("c1_cache_lookup", with_sql(_CACHE, select="""
  SELECT c_custkey AS id, CASE WHEN key IS NULL THEN 'miss' WHEN 1706659200.0 - ts > 86400.0 THEN 'expired' WHEN cover_url IS NULL THEN 'negative' ELSE 'hit' END AS state,
         CASE WHEN 1706659200.0 - ts <= 86400.0 THEN cover_url END AS cover_url
  FROM customer LEFT JOIN covers ON key = CAST(c_custkey AS VARCHAR)"""))
def c1(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ttl.cache_key(F.col("c_custkey").cast("string")).alias("key"))
    return ttl.lookup(asked, cover_cache(spark, sf), AS_OF, TTL).drop("key")


@query("c2_cache_put", with_sql(_CACHE, select="SELECT key, cover_url, round(ts, 3) AS ts FROM covers"))
def c2(spark, sf):
    return cover_cache(spark, sf).select("key", "cover_url", F.round("ts", 3).alias("ts"))


@query("c3_cache_invalidate", with_sql(_CACHE, select="SELECT key, cover_url FROM covers WHERE key NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"))
def c3(spark, sf):
    gone = _supplier(spark, sf).select(F.col("s_suppkey").cast("string").alias("key"))
    return ttl.invalidate(cover_cache(spark, sf), gone).select("key", "cover_url")


@query("c4_cache_expire", with_sql(_CACHE, select="SELECT key, cover_url FROM covers WHERE 1706659200.0 - ts <= 86400.0"))
def c4(spark, sf):
    return ttl.drop_expired(cover_cache(spark, sf), AS_OF, TTL).select("key", "cover_url")


@query("c5_cache_stats", with_sql(_CACHE, select="""
  SELECT count(*) AS total_entries, count(*) FILTER (WHERE 1706659200.0 - ts <= 86400.0) AS valid_entries,
         count(*) FILTER (WHERE 1706659200.0 - ts > 86400.0) AS expired_entries, count(cover_url) AS entries_with_covers,
         count(*) - count(cover_url) AS entries_without_covers FROM covers"""))
def c5(spark, sf):
    return ttl.stats(cover_cache(spark, sf), AS_OF, TTL)
