"""Helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are what lies between these six characters; in Python, bytes.split() cuts at the same six.
SPACE = "[\\x20\\x09-\\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither repeat the work nor lose it with an executor.

    What was shuffled for it is removed when it is written; else Spark does so after some collection of garbage.
    """
    path = scratch_path(df.sparkSession, "llm")
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Words of the text with A-Z lowered; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda word: word != "")
