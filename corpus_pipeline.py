"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfgraph.llm import curriculum, exact_dedup, jaccard_join, quality_model, sentence_pieces
from shelfgraph.llm.queries import table
from shelfgraph.session import work_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, does not reject."""
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def one_of_near_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams at a Jaccard similarity of 0.8 or more: the one with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents in training order, repeated as their source's target asks."""
    return curriculum.training_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the mix as SentencePiece ids, with the check that decoding them gives its text."""
    import public_tokenizers

    pieces = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = sentence_pieces.round_trip(docs, pieces, with_ids=True)
    return found.selectExpr("id AS doc_id", "n_ids AS n_tokens", "ids_crc32", "restored", "ids")


STAGES = [("quality classifier", good_documents), ("exact dedup", one_of_equals), ("n-gram Jaccard join", one_of_near_equals),
          ("mixing sources", mixed), ("SentencePiece encoding", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; what each stage keeps is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return result
        path = work_dir(spark, f"pipeline-{k}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
