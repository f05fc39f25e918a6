"""Lookup table with expiry: the cover cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.nodes import placeholder_cover
from shelfgraph.functions.text import col


def cache_key(isbn, title=None) -> Column:
    """``isbn`` or ``isbn:title``."""
    if title is None:
        return col(isbn)
    return F.when(F.coalesce(col(title), F.lit("")) != "", F.concat_ws(":", col(isbn), col(title))).otherwise(col(isbn))


def valid_at(as_of: float, ttl: float, ts: str = "ts") -> Column:
    return (F.lit(float(as_of)) - F.col(ts)) <= F.lit(float(ttl))


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Cache with the entries added: the newest entry of a key replaces the whole row.

    Entries without an isbn are ignored; a null cover is a negative entry. One hash aggregate with
    map-side combine over both inputs, ties broken by the cover text.
    """
    rows = cache.unionByName(entries.filter(F.coalesce("isbn", F.lit("")) != ""))
    rest = [c for c in rows.columns if c != "key"]
    newest = F.struct("ts", F.coalesce("cover_url", F.lit("")))
    best = rows.groupBy("key").agg(F.max_by(F.struct(*rest), newest).alias("r"))
    return best.select("key", "r.*").select(*rows.columns)


def lookup(requests: DataFrame, cache: DataFrame, as_of: float, ttl: float) -> DataFrame:
    """Requests ``(key, ...)`` with the valid cover and how it was found: hit, negative, expired or miss."""
    c = cache.select(F.col("key").alias("_k"), "cover_url", F.col("ts").alias("_ts"))
    fresh = valid_at(as_of, ttl, "_ts")
    state = (
        F.when(F.col("_k").isNull(), "miss").when(~fresh, "expired").when(F.col("cover_url").isNull(), "negative").otherwise("hit")
    )
    return (
        requests.join(c, F.col("key") == F.col("_k"), "left").withColumn("state", state)
        .withColumn("cover_url", F.when(F.col("state") == "hit", F.col("cover_url"))).drop("_k", "_ts")
    )


def invalidate(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Cache without these keys, or empty when none are given."""
    return cache.filter(F.lit(False)) if keys is None else cache.join(keys.select("key"), "key", "left_anti")


def drop_expired(cache: DataFrame, as_of: float, ttl: float) -> DataFrame:
    return cache.filter(valid_at(as_of, ttl))


def stats(cache: DataFrame, as_of: float, ttl: float) -> DataFrame:
    covered = F.coalesce("cover_url", F.lit("")) != ""
    return cache.agg(
        F.count("*").alias("total_entries"), F.count_if(valid_at(as_of, ttl)).alias("valid_entries"),
        F.count_if(~valid_at(as_of, ttl)).alias("expired_entries"),
        F.count_if(covered).alias("entries_with_covers"), F.count_if(~covered).alias("entries_without_covers"),
    )


def resolve_covers(works: DataFrame, cache: DataFrame, url_status: DataFrame, as_of: float, ttl: float) -> DataFrame:
    """Cover of each work: stored, else a cached one that still answers, else a placeholder.

    ``works(id, isbn, genre, publisher, cover_image_url)``; ``url_status(url, ok)``, one row per url.
    """
    found = lookup(works.withColumn("key", cache_key("isbn")), cache, as_of, ttl).drop("key")
    ok = url_status.select(F.col("url").alias("_url"), F.col("ok").alias("_ok"))
    tested = found.join(ok, F.col("cover_url") == F.col("_url"), "left")
    stored = F.coalesce("cover_image_url", F.lit("")) != ""
    live = F.coalesce("_ok", F.lit(False))
    return tested.select(
        "id",
        F.when(stored, F.col("cover_image_url")).when(live, F.col("cover_url"))
        .otherwise(placeholder_cover("genre", "publisher")).alias("cover_url"),
        F.when(stored, "stored").when(live, "api").otherwise("placeholder").alias("source"),
        (stored | live).alias("has_real_cover"),
    )
