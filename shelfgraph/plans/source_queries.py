"""Scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgraph.operators.tabular import rows_by_title
from shelfgraph.plans import source_binding as B
from shelfgraph.plans.binding import CREDITS_SQL, GRAPH_SQL, WORKS_SQL, catalogue, catalogue_view, titles, with_sql
from shelfgraph.plans.registry import query, table
from shelfgraph.sources import api_json, catalogue as C, cells, jsonld, lookups

_BOOK = """
book AS (
  SELECT l.*, p_name, s_name, n_name, strftime(l_shipdate, '%Y-%m-%d') AS day,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m-%d') AS file
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query("s1_jsonld_scan", with_sql(_BOOK, select="""
  SELECT file, 0 AS pos, 'book:' || file AS id, 'class:MangaBook' AS type FROM book
  UNION ALL SELECT 's' || p_partkey, 0, 'series:' || p_partkey, 'class:MangaBookSeries' FROM part
  UNION ALL SELECT 'm' || n_nationkey, 0, 'mag:' || n_nationkey, 'class:MangaMagazine' FROM nation"""))
def s1(spark, sf):
    items = B.items(spark, sf)
    return items.select("file", "pos", jsonld.field("item", "@id", "string").alias("id"), jsonld.field("item", "@type", "string").alias("type"))


@query("s1_jsonld_items_in_order", """
  SELECT l_orderkey::VARCHAR AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, 'book:' || l_linenumber AS id
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""")
def s1_items(spark, sf):
    """One document per order with all its lines as items; ids repeat inside a document."""
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    one = lambda e: F.concat(F.lit('{"@id":"book:'), e["l_linenumber"].cast("string"), F.lit('"}'))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    texts = lines.select(F.col("l_orderkey").cast("string").alias("file"),
                         F.concat(F.lit('{"@graph":['), F.array_join(F.transform("lines", one), ","), F.lit("]}")).alias("text"))
    return jsonld.items_of(texts).select("file", F.col("pos").cast("bigint").alias("pos"), jsonld.field("item", "@id", "string").alias("id"))


@query("s2_polymorphic_strings", with_sql(_BOOK, select="""
  SELECT file, p_name || ' ' || l_linenumber AS names, n_name AS publishers, '[著]' || s_name || '|編集部' AS creators,
         'creator:' || l_suppkey AS creator_ids, l_linestatus = 'O' AS one_creator FROM book"""))
def s2(spark, sf):
    return B.typed_books(spark, sf).select(
        "file", F.array_join("names", "|").alias("names"), F.array_join("publishers", "|").alias("publishers"),
        F.array_join("creator_names", "|").alias("creators"), F.array_join("creator_ids", "|").alias("creator_ids"), "one_creator")


@query("s3_typed_cells", """
  SELECT c_custkey AS id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'float' WHEN 'AUTOMOBILE' THEN 'int' WHEN 'MACHINERY' THEN 'list' WHEN 'HOUSEHOLD' THEN NULL
           ELSE CASE WHEN c_custkey % 4 = 2 THEN 'object' ELSE 'text' END END AS kind,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_custkey END AS whole,
         CASE c_mktsegment WHEN 'BUILDING' THEN c_acctbal WHEN 'AUTOMOBILE' THEN CAST(c_custkey AS DOUBLE) END AS number,
         CASE c_mktsegment WHEN 'MACHINERY' THEN c_name || '|x' END AS items,
         CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') THEN
           CASE c_custkey % 4 WHEN 0 THEN c_custkey || 'D' WHEN 1 THEN c_custkey || '.5f' WHEN 2 THEN '{"a": ' || c_custkey || ', "b": "None", "c": null}' ELSE c_name END END AS text
  FROM customer""")
def s3(spark, sf):
    seg = F.col("c_mktsegment")
    raw = (
        F.when(seg == "BUILDING", F.col("c_acctbal").cast("string")).when(seg == "AUTOMOBILE", F.col("c_custkey").cast("string"))
        .when(seg == "MACHINERY", F.concat(F.lit('[""'), "c_name", F.lit('"",""x""]'))).when(seg == "HOUSEHOLD", F.lit(" Unknown "))
        .when(F.col("c_custkey") % 4 == 0, F.concat("c_custkey", F.lit("D"))).when(F.col("c_custkey") % 4 == 1, F.concat("c_custkey", F.lit(".5f")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("{'a': "), "c_custkey", F.lit(", 'b': 'None', 'c': None}")))
        .otherwise(F.concat(F.lit(" "), "c_name"))
    )
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), cells.typed_cell(raw).alias("v"))
    return v.select("id", "v.kind", "v.whole", "v.number", F.array_join("v.items", "|").alias("items"), "v.text")


@query("s3_object_cells", "SELECT event_id, 'object' AS kind, props AS text FROM events")
def s3_objects(spark, sf):
    v = table(spark, sf, "events").select("event_id", cells.typed_cell("props").alias("v"))
    return v.select("event_id", "v.kind", "v.text")


@query("s4_list_cells", """
  SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN NULL WHEN p_size <= 5 THEN p_brand || '|-' ELSE p_brand || '|' || p_type END AS strict,
         CASE WHEN p_size <= 5 THEN p_brand || '|-' ELSE p_brand || '|' || p_type END AS loose FROM part""")
def s4(spark, sf):
    one, two = F.col("p_brand"), F.col("p_type")
    raw = (
        F.when(F.col("p_size") > 40, F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
        .when(F.col("p_size") > 25, F.concat(F.lit("['"), one, F.lit("', '"), two, F.lit("']")))
        .when(F.col("p_size") <= 5, F.concat(F.lit("['"), one, F.lit("', None]")))
        .otherwise(F.concat(F.lit('["'), one, F.lit('","'), two, F.lit('"]')))
    )
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), raw.alias("c"))
    return rows.select("id", F.array_join(cells.list_cell("c"), "|", "-").alias("strict"), F.array_join(cells.loose_list_cell("c"), "|", "-").alias("loose"))


@query("s5_relation_rows", """
  SELECT CAST(p_partkey AS VARCHAR) AS work_id, p_name AS title, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_brand END AS authors,
         CASE WHEN p_size > 25 THEN '' ELSE p_type END AS magazines
  FROM part WHERE p_type <> 'PROMO' OR p_size <= 25""")
def s5(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("title_name"), F.col("p_name").alias("english_name"),
        F.when(F.col("p_type") != "PROMO", F.concat(F.lit('["'), "p_brand", F.lit('"," '), "p_brand", F.lit('","n/a"]'))).alias("authors"),
        F.when(F.col("p_size") > 25, F.lit("[]")).otherwise(F.concat(F.lit("['"), "p_type", F.lit("']"))).alias("serialization"))
    rows = cells.relation_rows(raw)
    return rows.select("work_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("magazines", "|").alias("magazines"))


@query("s6_api_records", "SELECT CAST(l_orderkey AS VARCHAR) AS id, min(l_partkey || '-' || l_linenumber) AS file FROM lineitem GROUP BY l_orderkey")
def s6(spark, sf):
    record = F.concat(F.lit('{"id":'), F.col("l_orderkey").cast("string"), F.lit("}"))
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("["), record, F.lit("]"))).when(
        F.col("l_returnflag") == "A", F.concat(F.lit('{"metadata":{},"manga":['), record, F.lit("]}"))
    ).otherwise(F.concat(F.lit('{"anime":['), record, F.lit("]}")))
    texts = table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_partkey"), F.col("l_linenumber")).alias("file"), text.alias("text"))
    return api_json.records_of(texts).select("id", "file")


@query("s7_publisher_mapping", """
  SELECT r_name AS publisher, unnest([n_name, 'Unknown', 'NA']) AS magazine, unnest([0, 1, 2]) AS rank FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey IN (SELECT max(n_nationkey) FROM nation GROUP BY n_regionkey)""")
def s7(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit('{" '), "r_name", F.lit(' ":["replaced"],"other":"no list","'), "r_name", F.lit('":["'), "n_name", F.lit('"," '), "n_name",
                    F.lit('  ","Unknown",7,null," ","NA"],"'), "r_name", F.lit('  ":[]}'))
    return lookups.publisher_magazines(rows.select(F.col("n_nationkey").alias("pos"), text.alias("text")))


@query("s8_brand_lookup", "SELECT p_brand AS key, arg_max(p_type, p_partkey) AS value FROM part GROUP BY p_brand")
def s8(spark, sf):
    text = F.concat(F.lit('{"c":{"'), "p_brand", F.lit('":"-"},"d":{"'), "p_brand", F.lit('":"'), "p_type", F.lit('"}}'))
    return lookups.brand_magazines(table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), text.alias("text")))


@query("s9_synopsis_rows", """
  SELECT p_partkey AS manga_id, replace(p_name, ' ', '') AS title, lower(p_type) AS synopsis FROM part WHERE p_size > 10""")
def s9(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("manga_id"), F.concat("p_name", F.lit("～（x）!")).alias("title_japanese"),
        F.when(F.col("p_size") > 10, F.concat(F.lit(" "), F.lower("p_type"))).alias("synopsis"))
    return cells.synopsis_rows(rows)


@query("s10_label_listing", with_sql(GRAPH_SQL, select="SELECT id, label FROM nodes WHERE type = 'author' ORDER BY id LIMIT 100"))
def s10(spark, sf):
    return C.listing(catalogue(spark, sf), "author", 100).select("id", "label")


@query("s11_title_filter", "SELECT 'work:' || p_partkey AS id, p_name AS title_name FROM part WHERE contains(lower(p_name), 'ring')")
def s11(spark, sf):
    return C.works_titled(titles(spark, sf), "RING", title="title_name").select("id", "title_name")


@query("s12_keyset_page", """
  SELECT 'work:' || p_partkey AS id FROM part WHERE 'work:' || p_partkey > 'work:15' AND p_size > 25 ORDER BY id LIMIT 100""")
def s12(spark, sf):
    lacking = C.unfinished(titles(spark, sf), ["japanese_name"])
    return C.page(lacking, "id", "work:15", 100).select("id")


@query("s13_structure_profile", with_sql(_BOOK, """
shapes AS (
  SELECT unnest(['@id', '@type', 'schema:genre', 'schema:volumeNumber', 'schema:datePublished', 'schema:description']) AS key, 'STRING' AS shape FROM book
  UNION ALL SELECT 'schema:creator', 'ARRAY<STRING>' FROM book
  UNION ALL SELECT unnest(['schema:name', 'schema:publisher']),
    CASE l_returnflag WHEN 'R' THEN 'STRING' WHEN 'A' THEN 'ARRAY<STRING>' ELSE 'OBJECT<@value: STRING>' END FROM book
  UNION ALL SELECT 'dcterms:creator', CASE l_linestatus WHEN 'O' THEN 'OBJECT<@id: STRING>' ELSE 'ARRAY<OBJECT<@id: STRING>>' END FROM book
  UNION ALL SELECT unnest(['@id', '@type', 'schema:genre', 'schema:name']), 'STRING' FROM part
  UNION ALL SELECT 'schema:brand', 'ARRAY<STRING>' FROM part
  UNION ALL SELECT unnest(['@id', '@type', 'schema:genre', 'schema:name']), 'STRING' FROM nation
  UNION ALL SELECT 'schema:publisher', 'ARRAY<STRING>' FROM nation)""",
  select="SELECT key, replace(shape, '@', '@') AS shape, count(*) AS n FROM shapes GROUP BY ALL"))
def s13(spark, sf):
    profile = jsonld.structure_profile(B.items(spark, sf))
    return profile.withColumn("shape", F.replace("shape", F.lit("`"), F.lit("")))


@query("s14_title_probe", with_sql(_BOOK, select="SELECT 'book:' || file AS id FROM book WHERE contains(upper(p_name), 'ANVIL')"))
def s14(spark, sf):
    books = jsonld.items_of(B.book_texts(spark, sf))
    return jsonld.name_probe(books, "anvil").select(jsonld.field("item", "@id", "string").alias("id"))


@query("s15_payload_base64", "SELECT url, to_base64(encode(html)) AS data, octet_length(encode(html)) AS size, true AS success FROM pages")
def s15(spark, sf):
    return C.payloads(table(spark, sf, "pages").select("url", F.encode("html", "UTF-8").alias("content")))


@query("s16_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def s16(spark, sf):
    return C.preview(table(spark, sf, "orders"), 100, F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("s17_catalogue_rows", with_sql(WORKS_SQL, CREDITS_SQL, select="""
  SELECT id AS uri, title_name AS title, genre, first_published AS published_date, c.name AS creator_name,
         'creator:' || c.name AS creator_uri, (SELECT min(name) FROM credits p WHERE p.kind = 'publisher' AND p.work_id = id) AS publisher
  FROM works LEFT JOIN (SELECT * FROM credits WHERE kind = 'creator') c ON c.work_id = id
  WHERE contains(lower(title_name), 'red') ORDER BY uri, creator_uri LIMIT 50"""))
def s17(spark, sf):
    return rows_by_title(catalogue_view(spark, sf), "red", 50)
