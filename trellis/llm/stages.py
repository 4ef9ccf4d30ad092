"""The stages of the corpus pipeline. Each takes documents and gives those that stay, with all their columns, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bpe, decontaminate, neardup, quality, toxicity
from trellis.llm.runtime import table

#: A document goes from this score on.
TOXIC = 0.3
#: Words of a shingle, and the share of two texts' shingles from which on they are near duplicates.
SHINGLE, SHARE = 5, 0.8


def _names(docs: DataFrame) -> tuple[str, ...]:
    return tuple(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier, learned from the labelled rows that aren't held out, scores ``TOXIC`` or more.

    Null and empty texts have the score of no evidence. Repeated rows, and rows with null
    or repeated ids, are judged like any other, each by its text, so copies go or stay
    together. A long text is scored whole. Without toxic labels nothing goes.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    return toxicity.score(docs, model, carry=_names(docs)).where(F.col("score") < TOXIC).select("carried.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail a quality rule.

    Null, empty and other texts of fewer than 20 words go. Repeated rows, and rows with
    null or repeated ids, are judged like any other, each by its whole text.
    """
    return quality.quality(docs, carry=_names(docs)).where("kept").select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates over ``SHINGLE`` words: one with the least doc_id, one without doc_id only if none has one.

    Two texts link if they have ``SHARE`` or more of their distinct shingles in common, and
    links reach on. Null and empty texts have none and are one group; texts of fewer words
    are one shingle, so equal ones link. Of repeated rows one stays. Long texts count whole.
    """
    rows, nodes = neardup.cluster(docs, shingle=SHINGLE, share=SHARE)
    stay = nodes.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(stay, "at", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which one word in 20 or more stands in a window of the benchmark.

    A null or empty text has no words and stays, as all do where the benchmark is empty.
    Repeated rows, and rows with null or repeated ids, are judged like any other.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=_names(docs)).where(~F.col("contaminated")).select("carried.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document.

    A null or empty text has no ids. Repeated rows, and rows with null or repeated ids, are
    rows of the result. Other columns than doc_id and text don't come along.
    """
    return bpe.encode_documents(docs, bpe.vocabulary_path(), texts=False).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
