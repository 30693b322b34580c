"""Profiles of columns: quantiles, nulls, cardinality, lengths, dates, frequencies."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import count_of, ratio, share_of
from claimscope.operators.quantiles import column_quantiles

# Sketches of 2^12 registers are off by 1.6 % (standard error).
SKETCH_PRECISION = 12
QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _tall(df: DataFrame, aggregates: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row per column from one wide aggregate: {column: {statistic: expression}}."""
    wide = df.agg(*[
        F.struct(F.lit(name).alias("column"), *[value.alias(key) for key, value in parts.items()]).alias(f"s{i}")
        for i, (name, parts) in enumerate(aggregates.items())
    ])
    return wide.select(F.inline(F.array(*wide.columns)))


def numeric_profile(df: DataFrame, cols: Sequence[str], probabilities: Mapping[str, float] = QUARTILES) -> DataFrame:
    """Per column: min, max, mean, sample deviation and exact quantiles."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    moments = _tall(doubles, {
        c: {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "std": F.stddev_samp(c)} for c in cols
    })
    return moments.join(numeric_quantiles(df, cols, probabilities), "column", "left")


def numeric_quantiles(df: DataFrame, cols: Sequence[str], probabilities: Mapping[str, float] = QUARTILES) -> DataFrame:
    """Per column: exact quantiles, all columns in the same scans."""
    return column_quantiles(df, cols, probabilities)


def one_pass(df: DataFrame, numbers: Sequence[str], dates: Sequence[str], rates: Mapping[str, Column]) -> DataFrame:
    """One row from one pass: rows, nulls of every column, moments of numbers, range of dates, and rows for which conditions hold.

    Columns: ``rows``, ``nulls`` / ``numbers`` / ``dates`` / ``rates`` as arrays of structs, in the shapes of the single profiles.
    """
    rows = F.count(F.lit(1))

    def structs(parts: Mapping[str, Mapping[str, Column]]) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in own.items()]) for name, own in parts.items()])

    missing = {name: count_of(F.col(name).isNull()) for name in df.columns}
    return df.agg(
        rows.alias("rows"),
        structs({
            name: {"type": F.lit(kind), "null_count": missing[name], "null_pct": 100 * ratio(missing[name], rows)} for name, kind in df.dtypes
        }).alias("nulls"),
        structs({
            name: {"min": F.min(value), "max": F.max(value), "mean": F.avg(value), "std": F.stddev_samp(value)}
            for name in numbers for value in [F.col(name).cast("double")]
        }).alias("numbers"),
        structs({
            name: {"first": F.min(value), "last": F.max(value), "unparseable": count_of(value.isNull())}
            for name in dates for value in [F.col(name).try_cast("date")]
        }).alias("dates"),
        structs({name: {"n": count_of(condition), "total": rows, "pct": 100 * share_of(condition)} for name, condition in rates.items()}).alias("rates"),
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for the non-null values of text columns, in one pass."""
    long = df.select(*[F.col(name).cast("string").alias(name) for name in cols]).unpivot([], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: its type, and the number and percentage of nulls."""
    return _tall(df, {
        name: {
            "type": F.lit(kind),
            "null_count": count_of(F.col(name).isNull()),
            "null_pct": 100 * ratio(count_of(F.col(name).isNull()), F.count(F.lit(1))),
        }
        for name, kind in df.dtypes
    })


def cardinality(df: DataFrame) -> DataFrame:
    """Per column: number of distinct non-null values, compared as values of their type (0.0 equals -0.0)."""
    kinds: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        kinds.setdefault(kind, []).append(name)
    parts = []
    for names in kinds.values():
        long = df.select(*names).unpivot([], names, "column", "value").where(F.col("value").isNotNull())
        parts.append(long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def cardinality_sketches(df: DataFrame, cols: Sequence[str], by: str, precision: int = SKETCH_PRECISION) -> DataFrame:
    """Per value of ``by``, such as a month, a HyperLogLog sketch of each column: a stage table of a few kilobytes a column and row, which sketches of later months join."""
    return df.groupBy(by).agg(*[F.hll_sketch_agg(F.col(name).cast("string"), precision).alias(name) for name in cols])


def sketched_cardinality(sketches: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: about how many distinct non-null values there are over all rows of ``cardinality_sketches``, and three standard errors of that.

    An approximation of ``cardinality`` that never reads or shuffles the values again. Values are compared as text.
    """
    united = sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in cols])
    error = 3 * 1.04 / math.sqrt(2**SKETCH_PRECISION)
    return united.unpivot([], list(cols), "column", "about").withColumn("margin", F.ceil(F.col("about") * error).cast("bigint"))


def length_histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.length(F.col(col).cast("string")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def date_profile(df: DataFrame, col: str) -> DataFrame:
    """First and last date, and the number of values that are no date."""
    parsed = F.col(col).try_cast("date")
    return df.agg(
        F.min(parsed).alias("first"), F.max(parsed).alias("last"), count_of(parsed.isNull()).alias("unparseable")
    )


def frequency(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Rows and percentage per value, most frequent first; the first n of them."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = counts.withColumn("pct", 100 * ratio(F.col("n"), total))
    return shares if n is None else shares.orderBy(F.desc("n"), col).limit(n)


def rate_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(
        count_of(condition).alias("n"), F.count(F.lit(1)).alias("total"), (100 * share_of(condition)).alias("pct")
    )


def compare_groups(df: DataFrame, group: str, medians: Mapping[str, str], means: Mapping[str, str]) -> DataFrame:
    """Per group: count and share of all rows, medians and means of columns: {output: column}."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    result = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(column).alias(name) for name, column in means.items()]
    ).withColumn("pct", 100 * ratio(F.col("n"), total))
    middle = column_quantiles(df, list(dict.fromkeys(medians.values())), {"_median": 0.5}, group)
    wide = middle.groupBy(group).agg(*[F.max(F.when(F.col("column") == column, F.col("_median"))).alias(name) for name, column in medians.items()])
    names = wide.withColumnRenamed(group, "_name")
    return result.join(F.broadcast(names), F.col(group).eqNullSafe(F.col("_name")), "left").drop("_name")
