"""A training corpus from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import stages
from trellis.llm.runtime import staged, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality", stages.drop_poor),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("encoding", stages.encode),
]

#: Neither compression distance nor BPE is SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    *early, (_, last) = STAGES
    docs = reduce(lambda d, s: staged(spark, s[1](spark, d, sf_dir), f"corpus-{s[0]}"), early, docs)
    return last(spark, docs, sf_dir)
