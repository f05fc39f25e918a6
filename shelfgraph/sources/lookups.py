"""Mapping files: publisher to magazines, brand to magazine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.operators.limits import first_per_key
from shelfgraph.functions.text import collapse_spaces


def read_map_text(spark: SparkSession, path: str) -> DataFrame:
    """One row (pos, text) per mapping file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("pos"), F.col("value").alias("text"))


def publisher_magazines(texts: DataFrame) -> DataFrame:
    """(publisher, magazine, rank) of ``texts(pos, text)``; a publisher named again, in the same file too, replaces its list.

    Blank entries and entries that are no text are left out; every other name stays as it is, one that reads "Unknown" too.
    """
    entries = texts.select("pos", F.posexplode(F.map_entries(F.from_json("text", "map<string,variant>"))).alias("i", "e"))
    listed = F.try_variant_get(F.col("e.value"), "$", "array<variant>")
    written = F.filter(listed, lambda m: F.schema_of_variant(m) == "STRING")
    names = F.transform(written, lambda m: collapse_spaces(F.variant_get(m, "$", "string")))
    tidy = entries.select("pos", "i", collapse_spaces("e.key").alias("publisher"), F.array_distinct(F.filter(names, lambda n: n != "")).alias("magazines"))
    usable = tidy.filter((F.col("publisher") != "") & (F.size("magazines") > 0))
    last = first_per_key(usable, ["publisher"], [F.col("pos").desc(), F.col("i").desc()])
    return last.select("publisher", F.posexplode("magazines").alias("rank", "magazine"))


def brand_magazines(texts: DataFrame) -> DataFrame:
    """(key, value) brand to magazine of ``texts(pos, text)``; the later category wins."""
    categories = texts.select("pos", F.posexplode(F.map_entries(F.from_json("text", "map<string,map<string,string>>"))).alias("i", "c"))
    pairs = categories.select("pos", "i", F.explode("c.value").alias("key", "value"))
    return first_per_key(pairs, ["key"], [F.col("pos").desc(), F.col("i").desc()]).select("key", "value")
