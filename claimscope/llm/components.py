"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written


def _largest_first(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller one."""
    return (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node that it is connected to.

    Each round points neighbours at the smallest node around (first the larger neighbours, then the smaller ones); the number
    of rounds grows with the logarithm of the longest chain. Minima are aggregated before they are joined back, so a node
    with very many links is no single group. Every round is written to the shared folder. Null nodes are left out; a link
    from a node to itself adds nothing; no links give no rows.
    """
    edges = written(_largest_first(links.where(F.col("a").isNotNull() & F.col("b").isNotNull())))
    while True:
        # Finished when each node has one link, and what it points at points nowhere.
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        roots = edges.select(F.col("b").alias("a")).distinct()
        if lowest.where("n > 1").isEmpty() and edges.join(roots, "a", "left_semi").isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(around, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(_largest_first(large))
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lowest.select("a", F.col("m").alias("b"))
        )
        edges = written(_largest_first(small))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
