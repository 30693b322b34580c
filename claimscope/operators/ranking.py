"""Ranks over a whole table, top-k, keep-first and top features of a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.scale import ordered_counts, ordered_rows, spread_join

# Scores are compared to this many decimals: sums over a cluster have no fixed order of addition.
RANK_DIGITS = 9


def rank_value(kind: str, desc: bool) -> Column:
    """Rank from the (ties, before, n) of ``ordered_counts``."""
    first = (F.col("n") - F.col("before") - F.col("ties") + 1) if desc else (F.col("before") + 1)
    average = first + (F.col("ties") - 1) / 2
    kinds = {
        "min": first.cast("bigint"),
        "average_floor": F.floor(average).cast("bigint"),
        "pct": average / F.col("n"),
    }
    return kinds[kind]


def global_rank(
    df: DataFrame, col: str, kind: str, out: str, desc: bool = True, digits: int = RANK_DIGITS,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Rank of ``col`` over the whole table: ``min``, ``average_floor`` (whole part of the average) or ``pct``.

    Rows with a null value get a null rank. ``df`` is read twice: cut it first if it is costly.
    """
    valued = df.withColumn("_value", F.round(F.col(col).cast("double"), digits))
    ordered = ordered_counts(valued, "_value")
    ranks = ordered.select("_value", rank_value(kind, desc).alias(out))
    counts = ordered.select("_value", F.col("ties").alias("n"))
    return spread_join(valued, ranks, "_value", "left", spread_by=spread_by or df.columns, counts=counts).drop("_value")


@dataclass(frozen=True)
class Rank:
    """A column to be ranked, and how: a kind of ``rank_value``, largest or smallest value first, compared to ``digits`` decimals."""

    column: str
    kind: str = "min"
    desc: bool = True
    digits: int = RANK_DIGITS


def global_ranks(df: DataFrame, keys: Sequence[str], ranks: Mapping[str, Rank], buckets: int | None = None) -> DataFrame:
    """``df`` with several ranks over the whole table, one column per name in ``ranks``; ``keys`` are unique in ``df`` and not null.

    All (rank, value, keys) rows are sorted together in ranges of values, one shuffle for any number of ranks, and brought back to a row per
    key by a second one. No rank is joined back on its value, so values with very many ties cost nothing. Rows
    with a null value get a null rank. ``df`` is read several times: cut it first if it is costly.
    """
    keys = list(keys)
    values = []
    for rank in ranks.values():
        value = F.round(F.col(rank.column).cast("double"), rank.digits)
        values.append((-value if rank.desc else value) + F.lit(0.0))  # the sum makes -0.0 of it 0.0
    placed = ordered_rows(df, keys, values, buckets)
    wide = placed.groupBy(*keys).agg(*[
        F.max(F.when(F.col("series") == i, rank_value(rank.kind, desc=False))).alias(out) for i, (out, rank) in enumerate(ranks.items())
    ])
    return df.join(wide, keys, "left")


def percentile_ranks(df: DataFrame, keys: Sequence[str], cols: Sequence[str], digits: int = RANK_DIGITS) -> DataFrame:
    """``<col>_pct`` for several columns at once: ascending average rank divided by the number of rows."""
    return global_ranks(df, keys, {f"{c}_pct": Rank(c, "pct", False, digits) for c in cols})


def top_k(df: DataFrame, col: str, k: int, tie: str | Sequence[str], desc: bool = False) -> DataFrame:
    """The k rows with the smallest (``desc``: largest) value; equal values in order of ``tie``. Nulls come last."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    first = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()
    return df.orderBy(first, *ties).limit(k)


def sort_head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def positions(df: DataFrame, col: str, k: int, tie: str, out: str, desc: bool = False) -> DataFrame:
    """The ids of ``top_k`` with their place 1..k. The window covers k rows."""
    first = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()
    return (
        top_k(df.select(tie, col), col, k, tie, desc)
        .withColumn(out, F.row_number().over(Window.partitionBy().orderBy(first, tie)))
        .select(tie, out)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of every key. Spark keeps n rows per key and task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("_place")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return first_per_key(df, keys, order, 1)


def top_features(z: DataFrame, id_col: str, features: Sequence[str], n: int) -> DataFrame:
    """The n features of greatest |z| of every row: (id, place, feature, abs_z). Works within the row, no shuffle."""
    entries = ", ".join(
        f"STRUCT(-ROUND(ABS(COALESCE(`{name}`, 0D)), {RANK_DIGITS}) AS order, '{name}' AS feature)" for name in features
    )
    return (
        z.selectExpr(id_col, f"POSEXPLODE(SLICE(ARRAY_SORT(ARRAY({entries})), 1, {n})) AS (place, entry)")
        .selectExpr(id_col, "place + 1 AS place", "entry.feature AS feature", "ABS(entry.order) AS abs_z")
    )


def movers(compared: DataFrame, id_col: str, delta: str = "rank_delta", k: int = 10) -> DataFrame:
    """The k largest and the k smallest rank changes, as ``climber`` and ``faller``."""
    up = top_k(compared, delta, k, id_col, desc=True).withColumn("direction", F.lit("climber"))
    down = top_k(compared, delta, k, id_col).withColumn("direction", F.lit("faller"))
    return up.unionByName(down)


def sorted_distinct(column: str | Column) -> Column:
    """Aggregate: sorted array of distinct non-null values, for keys with few values."""
    return F.sort_array(F.collect_set(column))
