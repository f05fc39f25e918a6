"""Documents and cells derived from the driver's tables, for the source operators.

Every line item becomes a book item, every part a series item, every nation a magazine item. The
polymorphic fields take their shape from a column of the row, so each shape occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.plans.registry import table
from shelfgraph.session import spread
from shelfgraph.sources.jsonld import items_of, typed_items


def _shaped(flag, value):
    """A JSON string, a list of it, or an object holding it."""
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    return (
        F.when(flag == "R", quoted).when(flag == "A", F.concat(F.lit("["), quoted, F.lit("]")))
        .otherwise(F.concat(F.lit('{"@value":'), quoted, F.lit("}")))
    )


def _doc(*parts):
    return F.concat(F.lit('{"@graph":[{'), F.concat_ws(",", *parts), F.lit("}]}"))


def _field(key: str, json):
    return F.concat(F.lit(f'"{key}":'), json)


def _text(key: str, value):
    return _field(key, F.concat(F.lit('"'), value, F.lit('"')))


def book_texts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = (
        spread(lines, "l_partkey").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    file = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), day)
    name = F.concat_ws(" ", "p_name", F.col("l_linenumber").cast("string"))
    creator = F.concat(F.lit('{"@id":"creator:'), F.col("l_suppkey").cast("string"), F.lit('"}'))
    return rows.select(file.alias("file"), _doc(
        _text("@id", F.concat(F.lit("book:"), file)), _text("@type", F.lit("class:MangaBook")),
        _text("schema:genre", F.lit("マンガ単行本")), _field("schema:name", _shaped(F.col("l_returnflag"), name)),
        _field("schema:creator", F.concat(F.lit('["[著]'), F.col("s_name"), F.lit('","編集部"]'))),
        _field("dcterms:creator", F.when(F.col("l_linestatus") == "O", creator).otherwise(F.concat(F.lit("["), creator, F.lit("]")))),
        _field("schema:publisher", _shaped(F.col("l_returnflag"), F.col("n_name"))),
        _text("schema:volumeNumber", F.col("l_linenumber").cast("string")), _text("schema:datePublished", day),
        _text("schema:description", F.concat(F.lit("初出：「"), F.col("n_name"), F.lit("」"))),
    ).alias("text"))


def series_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Series named after the whole part name, or only its first word; the brand names the magazine."""
    name = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1))
    key = F.col("p_partkey").cast("string")
    brand = F.concat(F.lit('["'), F.col("p_brand"), F.lit(' = x"]'))
    return spread(table(spark, sf, "part"), "p_partkey").select(F.concat(F.lit("s"), key).alias("file"), _doc(
        _text("@id", F.concat(F.lit("series:"), key)), _text("@type", F.lit("class:MangaBookSeries")),
        _text("schema:genre", F.lit("マンガ単行本シリーズ")), _text("schema:name", name), _field("schema:brand", brand),
    ).alias("text"))


def magazine_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("string")
    return rows.select(F.concat(F.lit("m"), key).alias("file"), _doc(
        _text("@id", F.concat(F.lit("mag:"), key)), _text("@type", F.lit("class:MangaMagazine")),
        _text("schema:genre", F.lit("マンガ雑誌")), _text("schema:name", F.col("n_name")),
        _field("schema:publisher", F.concat(F.lit('["'), F.col("r_name"), F.lit('"]'))),
    ).alias("text"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    texts = book_texts(spark, sf).unionByName(series_texts(spark, sf)).unionByName(magazine_texts(spark, sf))
    return items_of(texts)


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return typed_items(items(spark, sf))


def typed_books(spark: SparkSession, sf: str) -> DataFrame:
    return typed_items(items_of(book_texts(spark, sf)))


def typed_series(spark: SparkSession, sf: str) -> DataFrame:
    return typed_items(items_of(series_texts(spark, sf)))


def typed_magazines(spark: SparkSession, sf: str) -> DataFrame:
    return typed_items(items_of(magazine_texts(spark, sf)))


def brand_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand stands for the nation whose number its digits give, where there is one."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return brands.join(table(spark, sf, "nation"), number == F.col("n_nationkey")).select(
        F.col("p_brand").alias("key"), F.col("n_name").alias("value"))


def api_records(spark: SparkSession, sf: str) -> DataFrame:
    """One API record per part as text; large parts come wrapped with a ranking."""
    name = lambda c: F.struct(c.alias("name"))
    words = F.split("p_name", " ")
    related = F.array(F.struct(
        F.struct((F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("title")).alias("node"),
        F.lit("sequel").alias("relation_type"), F.when(F.col("p_size") > 25, F.lit("Sequel")).alias("relation_type_formatted")))
    node = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.struct(F.upper("p_name").alias("ja"), F.lower("p_type").alias("en"), F.array("p_brand").alias("synonyms")).alias("alternative_titles"),
        F.struct(F.when(F.col("p_size") > 10, F.concat(F.lit("l/"), "p_partkey")).alias("large"),
                 F.concat(F.lit("m/"), "p_partkey").alias("medium")).alias("main_picture"),
        F.col("p_retailprice").alias("mean"), F.col("p_size").alias("num_volumes"), F.col("p_size").alias("num_episodes"),
        F.col("p_size").alias("popularity"), F.col("p_type").alias("media_type"),
        F.array(name(F.col("p_type")), name(F.lit(None).cast("string"))).alias("genres"),
        F.array(name(F.col("p_brand"))).alias("studios"),
        F.struct(F.lit(2001).alias("year"), F.lower("p_type").alias("season")).alias("start_season"),
        F.struct(F.col("p_type").alias("day_of_the_week")).alias("broadcast"),
        F.array(F.struct(F.struct(words[0].alias("first_name"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("last_name")).alias("node"),
                         F.lit("Art").alias("role"))).alias("authors"),
        F.array(F.struct(name(F.col("p_brand")).alias("node"))).alias("serialization"),
        related.alias("related_manga"), F.when(F.col("p_size") > 25, related).alias("related_anime"),
    )
    bare = F.to_json(node)
    wrapped = F.to_json(F.struct(node.alias("node"), F.struct(F.col("p_size").alias("rank")).alias("ranking")))
    return spread(table(spark, sf, "part"), "p_partkey").select(
        F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 40, wrapped).otherwise(bare).alias("record"))
