"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing to target weights.

Each stage reads what the one before has written, and works on all of it. All but the last return the columns of documents; the
last adds the places in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimscope.llm import decontaminate, mixing, simhash, toxicity
from claimscope.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among ``docs``, doesn't call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item, also not with other numbers, names or units."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their places in a mix of sources weighted by the root of their sizes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

# The classifier's decisions can't be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, on the documents table; the result of each but the last is written before the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
