"""JSON-LD dumps: scan, polymorphic values, structure profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.functions.text import col, strip
from shelfgraph.sources import json_cut

# Vocabulary of the dumps (fixed values).
BOOK = ("class:MangaBook", "マンガ単行本")
SERIES = ("class:MangaBookSeries", "マンガ単行本シリーズ")
MAGAZINE_GENRES = ["マンガ雑誌", "雑誌", "雑誌全号まとめ"]
MAGAZINE_MARK = "Magazine"


def scan(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All ``@graph`` items of the files at ``path`` as (file, pos, item).

    One JSON document cannot be split, so a file is one task that only cuts it into items; with ``partitions`` the items
    are dealt out before they are parsed, for a few large files. Text that is no JSON gives a null item. Write the result
    to Parquet once and work from there; a dump with one item a line (``scan_lines``) is split by itself.
    """
    docs = spark.read.schema("`@graph` array<string>").option("multiLine", True).json(path)
    texts = docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("@graph").alias("pos", "text"))
    dealt = texts if partitions is None else texts.repartition(partitions)
    return dealt.select("file", "pos", F.try_parse_json("text").alias("item"))


def scan_split(spark: SparkSession, path: str) -> DataFrame:
    """The same of large documents, each read by many tasks: a document is cut into its items where it lies (see ``json_cut``)."""
    parts = json_cut.cut(spark, path, ["@graph"])
    return parts.select("file", F.col("pos").cast("int").alias("pos"), F.try_parse_json(json_cut.element_text("text")).alias("item"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one item a line, which are split at any size; ``pos`` is the byte block and place in it."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("pos"), F.try_parse_json("value").alias("item"))


def items_of(texts: DataFrame) -> DataFrame:
    """The same for documents held as rows ``(file, text)``: one parse per document."""
    graph = F.try_variant_get(F.try_parse_json("text"), "$['@graph']", "array<variant>")
    return texts.select("file", F.posexplode(graph).alias("pos", "item"))


def field(item, key: str, type_: str = "variant") -> Column:
    return F.try_variant_get(col(item), f"$['{key}']", type_)


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def as_strings(value, keys=("@value", "name"), single_object: bool = True) -> Column:
    """Strings of a value that may be text, an object, or a list of both; blanks are left out.

    An object gives its first present key. ``single_object=False`` ignores a bare object.
    """
    v = col(value)
    shape = F.schema_of_variant(v)

    def text(e: Column) -> Column:
        inner = F.coalesce(*[F.try_variant_get(e, f"$['{k}']", "variant") for k in keys])
        plain = lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
        return F.when(_kind(e) == "OBJECT", plain(inner)).otherwise(plain(e))

    accepted = F.lit(True) if single_object else ~shape.startswith("OBJECT")
    elements = F.when(shape.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(accepted, F.array(v))
    filled = lambda texts: F.filter(texts, lambda s: F.coalesce(s, F.lit("")) != "")
    one = lambda s: F.when(s != "", F.array(s)).otherwise(none)
    none = F.array().cast("array<string>")
    # The usual shapes are told from the whole value, outside of functions over elements, which are interpreted and share no results.
    found = F.when(shape == "STRING", one(F.try_variant_get(v, "$", "string")))
    if single_object:
        found = found.when(shape == _object_of(keys[0]), one(F.try_variant_get(v, f"$['{keys[0]}']", "string")))
    found = found.when(shape == "ARRAY<STRING>", filled(F.try_variant_get(v, "$", "array<string>")))
    return F.coalesce(found.otherwise(filled(F.transform(elements, text))), none)


def _object_of(key: str) -> str:
    """The shape of an object whose only field is a string."""
    return f"OBJECT<{key if key.isidentifier() else f'`{key}`'}: STRING>"


def as_ids(value) -> Column:
    """``@id`` of an object or of each object in a list."""
    v = col(value)
    shape = F.schema_of_variant(v)
    elements = F.when(shape.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    each = F.transform(elements, lambda e: F.when(_kind(e) == "OBJECT", F.try_variant_get(e, "$['@id']", "string")))
    present, none = lambda ids: F.filter(ids, lambda i: i.isNotNull()), F.array().cast("array<string>")
    one = F.try_variant_get(v, "$['@id']", "string")
    # An object, and a list of nothing else, need no look at each element.
    found = F.when(shape.startswith("OBJECT"), F.when(one.isNotNull(), F.array(one)).otherwise(none))
    found = found.when(shape.startswith("ARRAY<OBJECT"), present(F.try_variant_get(v, "$", "array<struct<`@id`: string>>")["@id"]))
    return F.coalesce(found.otherwise(present(each)), none)


def classify(type_, genre) -> Column:
    """book, series, magazine or null."""
    t, g = F.coalesce(col(type_), F.lit("")), F.coalesce(col(genre), F.lit(""))
    return (
        F.when((t == BOOK[0]) & (g == BOOK[1]), "book").when((t == SERIES[0]) & (g == SERIES[1]), "series")
        .when(g.isin(MAGAZINE_GENRES) | t.contains(MAGAZINE_MARK), "magazine")
    )


def typed_items(items: DataFrame) -> DataFrame:
    """Items as typed rows: the fields are taken out of the variant once, then become plain columns."""
    fields = ["schema:name", "schema:creator", "dcterms:creator", "schema:publisher", "schema:brand"]
    raw = items.select(
        "file", "pos", field("item", "@id", "string").alias("id"), field("item", "@type", "string").alias("type"),
        field("item", "schema:genre", "string").alias("genre"), field("item", "schema:volumeNumber", "string").alias("volume"),
        F.coalesce(field("item", "schema:datePublished", "string"), F.lit("")).alias("date_published"),
        field("item", "schema:description", "string").alias("description"),
        *[field("item", k).alias(k.replace(":", "_")) for k in fields],
    )
    return raw.select(
        "file", "pos", F.struct("file", "pos").alias("ord"), "id", classify("type", "genre").alias("kind"), "genre",
        as_strings("schema_name", keys=("@value",)).alias("names"),
        as_strings("schema_creator", single_object=False).alias("creator_names"),
        as_ids("dcterms_creator").alias("creator_ids"),
        F.coalesce(_kind(F.col("dcterms_creator")) == "OBJECT", F.lit(False)).alias("one_creator"),
        as_strings("schema_publisher").alias("publishers"),
        "volume", "date_published", "description", as_strings("schema_brand", keys=("@value",)).alias("brands"),
    )


def structure_profile(items: DataFrame, item: str = "item") -> DataFrame:
    """Top-level keys with the shape of their values and how often each occurs."""
    exploded = items.select(F.explode(F.try_variant_get(item, "$", "map<string,variant>")))
    return exploded.groupBy("key", F.schema_of_variant("value").alias("shape")).agg(F.count("*").alias("n"))


def name_probe(items: DataFrame, term: str) -> DataFrame:
    """Items one of whose names contains the term, compared in upper case."""
    names = as_strings(field("item", "schema:name"))
    return items.filter(F.exists(names, lambda n: F.upper(n).contains(term.upper())))

