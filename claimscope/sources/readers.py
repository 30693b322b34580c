"""Readers of the public files and readers/writers of stage tables.

Identifiers stay text, so leading zeros survive. Nothing is inferred from the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.columns import count_non_null
from claimscope.functions.constants import (
    EXCLUSION_COLUMNS, INDIVIDUAL_COLUMNS, NUM_TAXONOMIES, ORGANISATION_COLUMNS, PROVIDER_COLUMNS, SPENDING_COLUMNS,
)

DATE_COLUMNS = ["enumeration_date", "deactivation_date", "reactivation_date"]


FORMATS = ("csv", "parquet")


def _is_parquet(format: str) -> bool:
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}, not {format!r}")
    return format == "parquet"


def _read(spark: SparkSession, path: str, format: str) -> DataFrame:
    """A Parquet table, or a CSV file with header in which every column is text."""
    if _is_parquet(format):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_spending(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Spending by provider, procedure and month, with typed columns. A CSV row that doesn't fit the types is an error."""
    if _is_parquet(format):
        raw = spark.read.parquet(path)
    else:
        schema = T.StructType([
            T.StructField(header, T._parse_datatype_string(kind)) for header, (_, kind) in SPENDING_COLUMNS.items()
        ])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return raw.select(*[F.col(header).cast(kind).alias(name) for header, (name, kind) in SPENDING_COLUMNS.items()])


def read_registry(
    spark: SparkSession, path: str, columns: Mapping[str, str], date_format: str | None = None, format: str = "csv",
) -> DataFrame:
    """The named columns of the registry as text; with a date format, its date columns as dates (bad text: null)."""
    registry = _read(spark, path, format).select(*[F.col(f"`{header}`").cast("string").alias(name) for header, name in columns.items()])
    if date_format is None:
        return registry
    return registry.withColumns({
        name: F.try_to_timestamp(name, F.lit(date_format)).cast("date")
        for name in DATE_COLUMNS if name in registry.columns
    })


def read_providers(spark: SparkSession, path: str, date_format: str = "MM/dd/yyyy", format: str = "csv") -> DataFrame:
    """The registry as the provider features need it."""
    taxonomies = [f"taxonomy_{i}" for i in range(1, NUM_TAXONOMIES + 1)]
    registry = read_registry(spark, path, PROVIDER_COLUMNS, date_format, format)
    return (
        registry.withColumn("entity_type", F.col("entity_type").try_cast("int"))
        .withColumn("primary_taxonomy", F.col("taxonomy_1"))
        .withColumn("num_taxonomy_codes", count_non_null(taxonomies))
        .drop(*taxonomies)
    )


def read_organisations(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    return read_registry(spark, path, ORGANISATION_COLUMNS, format=format)


def read_individuals(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    return read_registry(spark, path, INDIVIDUAL_COLUMNS, format=format)


def read_deactivated(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Distinct identifiers of a one-column list; title rows and other text are dropped."""
    raw = spark.read.parquet(path) if _is_parquet(format) else spark.read.csv(path)
    return numeric_ids(raw, raw.columns[0])


def numeric_ids(df: DataFrame, column: str) -> DataFrame:
    npi = F.trim(F.col(column).cast("string"))
    return df.select(npi.alias("npi")).where(F.col("npi").try_cast("bigint").isNotNull()).distinct()


def read_exclusions(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """The exclusion list as text, blank where a value is missing."""
    raw = _read(spark, path, format)
    return raw.select(*[
        F.coalesce(F.col(header).cast("string"), F.lit("")).alias(name) for header, name in EXCLUSION_COLUMNS.items()
    ])


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, drop_arrays: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Write a stage table; ``drop_arrays`` leaves out array columns."""
    if drop_arrays:
        arrays = [field.name for field in df.schema.fields if isinstance(field.dataType, T.ArrayType)]
        df = df.drop(*arrays)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def rewrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions of a stage table for which ``df`` has rows, such as those of one corrected month; the files of all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_address() -> list[Column]:
    """The place of a row of Parquet files: the file's name and the row's number in it. The same on every partitioning."""
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def uniform_sample(df: DataFrame, n: int, seed: int, address: Sequence[str | Column] | None = None) -> tuple[int, DataFrame]:
    """The number of rows, and exactly n of them (all, if fewer) drawn without replacement, alike on any partitioning.

    A row's draw is the MD5 of the seed and its address, such as ``row_address`` for a table read from files: equal rows are drawn
    independently, and any SQL engine draws the same. Without an address the draw is a hash of all columns, and equal rows are drawn one
    after the other. Rows are first counted by the leading digits of the draw (4096 counts reach the driver), so
    that beyond the n rows only those of one more part in 4096 are sorted.
    """
    if address is None:
        draw, order = F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), *df.columns)), 16, "0")), [F.col(f"`{name}`") for name in df.columns]
    else:
        parts = [F.col(part) if isinstance(part, str) else part for part in address]
        draw, order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[part.cast("string") for part in parts])), []
    numbered = df.withColumn("_draw", draw)
    lead = F.substring("_draw", 1, 3)
    counts = sorted(tuple(row) for row in numbered.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(count for _, count in counts)
    last, taken = "", 0
    for part, count in counts:
        if taken >= n:
            break
        last, taken = part, taken + count
    return total, numbered.where(lead <= F.lit(last)).orderBy("_draw", *order).limit(n).drop("_draw")
