"""Prices compared with the peers that bill the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import ratio
from claimscope.operators.scale import spread_join


def peer_stats(code_agg: DataFrame, ddof: int, code: str = "hcpcs_code", price: str = "ppc") -> DataFrame:
    """Mean, deviation (population for ``ddof`` 0, sample for 1) and number of providers per code."""
    deviation = F.stddev_pop(price) if ddof == 0 else F.stddev_samp(price)
    return code_agg.groupBy(code).agg(
        F.avg(price).alias("avg_ppc"), deviation.alias("std_ppc"), F.count(F.lit(1)).alias("num_providers")
    )


def min_peers(stats: DataFrame, k: int, column: str = "num_providers") -> DataFrame:
    return stats.where(F.col(column) >= k)


def attach_peer_stats(code_agg: DataFrame, stats: DataFrame, code: str = "hcpcs_code", entity: str = "billing_npi",
                      counts: DataFrame | None = None) -> DataFrame:
    """Left join on the code. A code that a large share of providers bill is spread over tasks."""
    return spread_join(code_agg, stats, code, "left", spread_by=[entity], counts=counts)


def peer_zscore(
    df: DataFrame, entity: str = "billing_npi", code: str = "hcpcs_code", paid: str = "code_paid",
    claims: str = "code_claims", min_count: int = 5, ddof: int = 0,
) -> DataFrame:
    """z-score of each (entity, code) price; 0 where peers are too few or do not differ.

    ``df`` has one row per (entity, code) with the summed ``paid`` and ``claims``. It is read twice.
    """
    priced = df.withColumn("ppc", ratio(paid, claims))
    stats = peer_stats(priced, ddof, code)
    counts = stats.select(code, F.col("num_providers").alias("n"))
    joined = attach_peer_stats(priced, min_peers(stats, min_count), code, entity, counts)
    return joined.withColumn("peer_zscore", deviation_from_peers())


def deviation_from_peers() -> Column:
    z = F.when(F.col("std_ppc") > 0, (F.col("ppc") - F.col("avg_ppc")) / F.col("std_ppc"))
    return F.coalesce(z, F.lit(0.0))


def peer_rollup(z: DataFrame, entity: str = "billing_npi", paid: str = "code_paid", positive_only: bool = False) -> DataFrame:
    """Largest and payment-weighted mean z-score per provider.

    The mean is 0 where payments add up to zero, or with ``positive_only`` where they are not positive.
    """
    return z.groupBy(entity).agg(*rollup_aggregates(paid, positive_only))


def rollup_aggregates(paid: str = "code_paid", positive_only: bool = False) -> list[Column]:
    total = F.sum(paid)
    mean = ratio(F.sum(F.col("peer_zscore") * F.col(paid)), total)
    if positive_only:
        mean = F.when(total > 0, mean)
    return [F.coalesce(F.max("peer_zscore"), F.lit(0.0)).alias("max_peer_zscore"), F.coalesce(mean, F.lit(0.0)).alias("mean_peer_zscore")]
