"""Unions, intersections and differences of id and key sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import cut


def union_on(cols: Sequence[str], *frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [frame.select(*cols) for frame in frames])


def intersect_ids(*frames: DataFrame) -> DataFrame:
    """Ids in every frame; each frame has one id column."""
    return reduce(lambda left, right: left.join(right, left.columns[0], "left_semi"), [f.distinct() for f in frames])


def union_ids(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def minus_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, right.columns, "left_anti")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def attach_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], column: str, default) -> DataFrame:
    """Column of a table with unique keys, ``default`` where a key is missing."""
    joined = df.join(lookup.select(*on, column), list(on), "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(default)))


def attach_match_flag(df: DataFrame, matches: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """1 for rows whose key occurs among the matches, else 0."""
    marked = distinct_keys(matches, on).withColumn(out, F.lit(1))
    return attach_lookup(df, marked, on, out, 0)


def attach(detail: DataFrame, attrs: DataFrame, on: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    return detail.join(attrs.select(*keys, *cols), keys, "left")


def with_scalars(row: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of other one-row results, added as scalar subqueries."""
    return row.withColumns({
        name: other.select(name).scalar() for other in others for name in other.columns
    })


def attach_few(few: DataFrame, attrs: DataFrame, on: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Attach columns to the rows of a top-k report: the large side is filtered in place, not shuffled."""
    keys = [on] if isinstance(on, str) else list(on)
    few = cut(few)
    theirs = attrs.select(*keys, *cols).join(F.broadcast(few.select(*keys).distinct()), keys, "left_semi")
    return few.join(theirs, keys, "left")
