"""Substring search by a trigram index: the rarest trigrams of a term lead to the few rows that can hold it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.functions.text import col
from shelfgraph.session import staged
from shelfgraph.sources.keyed_files import KeyedFiles

INDEXED = ("title_name", "title", "english_name", "japanese_name", "name")
RAREST = 4  # trigrams of a term that are looked up


def trigrams(c) -> Column:
    """The distinct runs of three characters of a text in lower case, none for a shorter one."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    starts = F.when(F.length(text) > 2, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))


@dataclass(frozen=True)
class SubstringIndex:
    """``postings(gram, id)`` by gram, ``grams(gram, df)``, and the indexed rows themselves by id, or by the text that is their key."""

    postings: KeyedFiles
    grams: KeyedFiles
    rows: KeyedFiles

    @staticmethod
    def write(rows: DataFrame | KeyedFiles, path: str, columns: tuple[str, ...] = INDEXED, by_text: str | None = None) -> SubstringIndex:
        """Index the text columns of rows with an ``id``, which are stored by id unless they are already. Columns that the rows lack are passed over.

        Where few texts stand in many rows, ``by_text`` names their column: rows are stored by it, and each text is indexed once, however many rows have it.
        """
        if by_text is not None:
            others = [c for c in rows.columns if c != by_text]
            stored = KeyedFiles.write(staged(rows, "indexed-rows"), f"{path}/rows", by_text, *others)
            rows, columns = stored.all().select(by_text, F.col(by_text).alias("id")).filter(F.col(by_text).isNotNull()).distinct(), (by_text,)
        else:
            stored = rows if isinstance(rows, KeyedFiles) else KeyedFiles.write(staged(rows, "indexed-rows"), f"{path}/rows", "id")
            rows = stored.all()
        own = F.array_distinct(F.flatten(F.array(*[trigrams(c) for c in columns if c in rows.columns])))
        postings = staged(rows.select(F.explode(own).alias("gram"), "id"), "postings")
        return SubstringIndex(
            KeyedFiles.write(postings, f"{path}/postings", "gram", "id"),
            KeyedFiles.write(postings.groupBy("gram").agg(F.count("*").alias("df")), f"{path}/grams", "gram"), stored)

    @staticmethod
    def open(spark: SparkSession, path: str, rows: KeyedFiles | None = None, by_text: str | None = None) -> SubstringIndex:
        postings, grams = (KeyedFiles.open(spark, f"{path}/{name}", "gram") for name in ("postings", "grams"))
        return SubstringIndex(postings, grams, rows or KeyedFiles.open(spark, f"{path}/rows", by_text or "id"))

    def candidates(self, term: str) -> DataFrame | None:
        """Ids of the rows that have the rarest trigrams of a term; None for a term without trigrams, which any row may hold."""
        asked = self.postings.spark.createDataFrame([(term,)], "t string").select(trigrams("t")).first()[0]
        if not asked:
            return None
        known = sorted((r.df, r.gram) for r in self.grams.having(asked).collect())
        if len(known) < len(asked):
            return self.postings.having([]).select("id")
        rare = [g for _, g in known[:RAREST]]
        found = self.postings.having(rare).groupBy("id").agg(F.count_distinct("gram").alias("n"))
        return found.filter(F.col("n") == len(rare)).select("id")

    def holding(self, term: str | None) -> DataFrame:
        """The rows that can hold the term in an indexed column, read from their files; the caller's own test decides."""
        ids = self.candidates(term) if term else None
        return self.rows.all() if ids is None else self.rows.matching(ids)


def possible(rows: DataFrame, term: str | None, index: SubstringIndex | None, type_: str | None = None) -> DataFrame:
    """``rows``, or with an index over them those that can hold the term, of one node type if asked."""
    if index is None:
        return rows
    found = index.holding(term)
    return found if type_ is None else found.filter(F.col("type") == type_)
