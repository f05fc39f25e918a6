"""API dumps: scan, and records to work rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.functions.text import blank_to_null, strip
from shelfgraph.operators.limits import first_per_key
from shelfgraph.sources import json_cut
from shelfgraph.sources.jsonld import _kind

_NODE = "struct<id:bigint,title:string>"
_RELATED = f"array<struct<node:{_NODE},relation_type:string,relation_type_formatted:string>>"
_PICTURE = "struct<large:string,medium:string>"

# Record of the API (field names are fixed values).
RECORD = (
    "struct<id:bigint,title:string,main_picture:" + _PICTURE + ","
    "alternative_titles:struct<ja:string,en:string,synonyms:array<string>>,start_date:string,end_date:string,"
    "synopsis:string,background:string,mean:double,rank:bigint,popularity:bigint,num_list_users:bigint,"
    "num_scoring_users:bigint,nsfw:string,created_at:string,updated_at:string,media_type:string,status:string,"
    "genres:array<struct<id:bigint,name:string>>,num_volumes:int,num_chapters:int,num_episodes:int,"
    "start_season:struct<year:int,season:string>,broadcast:struct<day_of_the_week:string>,source:string,"
    "average_episode_duration:bigint,rating:string,studios:array<struct<id:bigint,name:string>>,"
    "authors:array<struct<node:struct<id:bigint,first_name:string,last_name:string>,role:string>>,"
    "serialization:array<struct<node:struct<id:bigint,name:string>>>,pictures:array<" + _PICTURE + ">,"
    f"related_manga:{_RELATED},related_anime:{_RELATED},recommendations:array<struct<node:{_NODE}>>>"
)
ENVELOPE = f"struct<node:{RECORD},ranking:struct<rank:bigint>>"
# Source marks written on the rows (fixed values).
API_SOURCE = "myanimelist_api"
API_SITE = "https://myanimelist.net"
# Columns that become edges and leave the node row.
LINKS = ["author_roles", "related_manga", "related_anime", "recommendations"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records of the dump files ``{manga|anime: [...]}`` or plain lists as (file, pos, record, id), first per id.

    One document cannot be split, so a file is one task; the records are spread by the next shuffle.
    """
    texts = spark.read.text(path, wholetext=True)
    return records_of(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def scan_split(spark: SparkSession, path: str) -> DataFrame:
    """The same of large dumps, each read by many tasks. Of a dump with records under both keys those under ``manga`` count."""
    parts = json_cut.cut(spark, path, ["manga", "anime", ""])
    own = parts.groupBy(F.col("file").alias("f")).agg(F.max("key").alias("k"))
    rows = parts.join(own, (F.col("file") == F.col("f")) & (F.col("key") == F.col("k")))
    rows = rows.select("file", F.col("pos").cast("int").alias("pos"), json_cut.element_text("text").alias("record"))
    keyed = rows.withColumn("id", F.get_json_object("record", "$.id")).filter(F.col("id").isNotNull())
    return first_per_key(keyed, ["id"], [F.col("file"), F.col("pos")])


def records_of(texts: DataFrame) -> DataFrame:
    """The same for documents held as rows ``(file, text)``."""
    wrapped = F.from_json("text", "struct<manga:array<string>,anime:array<string>>")
    plain = F.from_json("text", "array<string>")
    found = F.when(F.ltrim("text").startswith("["), plain).otherwise(F.coalesce(wrapped["manga"], wrapped["anime"]))
    rows = texts.select("file", F.posexplode(found).alias("pos", "record"))
    keyed = rows.withColumn("id", F.get_json_object("record", "$.id")).filter(F.col("id").isNotNull())
    return first_per_key(keyed, ["id"], [F.col("file"), F.col("pos")])


def parse_records(rows: DataFrame, record: str = "record") -> DataFrame:
    """(node, ranking_position) of bare or ``{node, ranking}`` records."""
    bare = F.from_json(record, RECORD)
    wrapped = F.from_json(record, ENVELOPE)
    return rows.select(
        F.when(bare["id"].isNotNull(), bare).otherwise(wrapped["node"]).alias("node"),
        wrapped["ranking"]["rank"].alias("ranking_position"),
    )


def _names(field: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(field, lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), empty)


def _related(field: str) -> Column:
    kept = F.filter(field, lambda r: r["node"]["id"].isNotNull())
    return F.transform(kept, lambda r: F.struct(
        r["node"]["id"].alias("id"), r["node"]["title"].alias("title"),
        F.coalesce(r["relation_type_formatted"], r["relation_type"]).alias("relation_type")))


def _picture(p: Column) -> Column:
    return F.coalesce(F.nullif(p["large"], F.lit("")), p["medium"])


def _common() -> list[Column]:
    pictures = F.transform(F.filter("node.pictures", lambda p: p.isNotNull()), _picture)
    suggested = F.filter("node.recommendations", lambda r: r["node"]["id"].isNotNull())
    return [
        F.col("node.id").alias("mal_id"), F.col("node.title").alias("title_name"),
        F.col("node.alternative_titles.ja").alias("japanese_name"), F.col("node.alternative_titles.en").alias("english_name"),
        F.coalesce("node.alternative_titles.synonyms", F.array().cast("array<string>")).alias("synonymns"),
        F.col("node.media_type").alias("item_type"), F.col("node.status").alias("status"), F.col("node.mean").alias("score"),
        F.col("node.num_scoring_users").alias("scored_by"), F.col("node.rank").alias("ranked"),
        F.col("node.popularity").alias("popularity"), F.col("node.num_list_users").alias("members"),
        F.col("node.start_date").alias("start_date"), F.col("node.end_date").alias("end_date"),
        F.col("node.synopsis").alias("description"), F.col("node.background").alias("background"),
        _names("node.genres").alias("genres"), F.col("node.nsfw").alias("nsfw"),
        _picture(F.col("node.main_picture")).alias("main_picture"), pictures.alias("pictures"),
        _related("node.related_manga").alias("related_manga"), _related("node.related_anime").alias("related_anime"),
        F.transform(suggested, lambda r: F.struct(r["node"]["id"].alias("id"), r["node"]["title"].alias("title"))).alias("recommendations"),
        F.col("node.created_at").alias("created_at"), F.col("node.updated_at").alias("updated_at"), F.col("ranking_position"),
    ]


def manga_works(parsed: DataFrame) -> DataFrame:
    """Manga records as work rows; fields a record lacks are null."""
    full = lambda a: strip(F.concat_ws(" ", a["node"]["first_name"], a["node"]["last_name"]))
    people = F.filter(F.transform("node.authors", lambda a: F.struct(
        full(a).alias("name"), F.coalesce(a["role"], F.lit("")).alias("role"))), lambda a: a["name"] != "")
    roles = F.coalesce(people, F.array().cast("array<struct<name:string,role:string>>"))
    key = F.col("node.id").cast("string")
    return parsed.filter(F.col("node.id").isNotNull()).select(
        key.alias("id"), *_common(), F.col("node.num_volumes").alias("volumes"), F.col("node.num_chapters").alias("chapters"),
        F.transform(roles, lambda a: a["name"]).alias("authors"), roles.alias("author_roles"),
        _names_of_nodes("node.serialization").alias("serialization"), F.lit(API_SOURCE).alias("source"),
        F.concat(F.lit(API_SITE + "/manga/"), key).alias("source_link"),
    )


def _names_of_nodes(field: str) -> Column:
    names = F.transform(field, lambda s: s["node"]["name"])
    return F.coalesce(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), F.array().cast("array<string>"))


def anime_works(parsed: DataFrame) -> DataFrame:
    """Anime records as work rows; ids carry a prefix so they never meet manga ids."""
    key = F.col("node.id").cast("string")
    season = blank_to_null(F.concat_ws(" ", "node.start_season.season", F.col("node.start_season.year").cast("string")))
    return parsed.filter(F.col("node.id").isNotNull()).select(
        F.concat(F.lit("anime_"), key).alias("id"), *_common(), F.col("node.num_episodes").alias("episodes"),
        season.alias("start_season"), F.col("node.broadcast.day_of_the_week").alias("broadcast"),
        F.col("node.source").alias("source"), F.col("node.average_episode_duration").alias("duration"),
        F.col("node.rating").alias("age_rating"), _names("node.studios").alias("studios"),
        F.lit(API_SOURCE).alias("data_source"), F.concat(F.lit(API_SITE + "/anime/"), key).alias("source_link"),
    )


def node_properties(works: DataFrame) -> DataFrame:
    """Work rows without the columns that become edges."""
    return works.drop(*LINKS)


def _elements(item, field: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, path: str = "$") -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return F.when(_kind(inner) == "STRING", F.try_variant_get(v, path, "string"))


def _inner(e: Column) -> Column:
    """The node of an entry, or the entry itself."""
    return F.coalesce(F.when(_kind(e) == "OBJECT", F.try_variant_get(e, "$.node", "variant")), e)


def serialization_entries(item) -> Column:
    """[{id, name}] of a serialization list given as names, ``{node}`` or bare objects."""

    def entry(e: Column) -> Column:
        node = _inner(e)
        named = F.when(_kind(node) == "STRING", strip(_text(node))).otherwise(_text(node, "$.name"))
        return F.struct(F.try_variant_get(node, "$.id", "bigint").alias("id"), named.alias("name"))

    return F.filter(F.transform(_elements(item, "serialization"), entry), lambda s: F.coalesce(s["name"], F.lit("")) != "")


def author_entries(item) -> Column:
    """[{id, name, first_name, last_name, role}] of an author list in the same three shapes; unnamed ones are skipped."""
    none = F.lit("")

    def entry(e: Column) -> Column:
        node = _inner(e)
        plain = _kind(node) == "STRING"
        first, last = F.coalesce(_text(node, "$.first_name"), none), F.coalesce(_text(node, "$.last_name"), none)
        name = F.when(plain, strip(_text(node))).otherwise(strip(F.concat_ws(" ", F.nullif(first, none), F.nullif(last, none))))
        return F.struct(
            F.try_variant_get(node, "$.id", "bigint").alias("id"), name.alias("name"),
            F.when(plain, none).otherwise(first).alias("first_name"), F.when(plain, none).otherwise(last).alias("last_name"),
            F.coalesce(F.when(_kind(e) == "OBJECT", _text(e, "$.role")), none).alias("role"))

    return F.filter(F.transform(_elements(item, "authors"), entry), lambda a: F.coalesce(a["name"], F.lit("")) != "")
