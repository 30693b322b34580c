"""Composite scores of cohort providers and of networks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import individual_score, name_penalty
from claimscope.functions.constants import COHORT_SCORED, COHORT_WEIGHTS, FLAG_WEIGHTS, PERCENTILE_WEIGHTS
from claimscope.operators.matching import best_tier
from claimscope.operators.networks import OFFICIAL
from claimscope.operators.ranking import RANK_DIGITS, Rank, global_ranks, percentile_ranks
from claimscope.operators.sets import attach_lookup, attach_match_flag
from claimscope.operators.standardize import extreme_count, preprocess
from claimscope.session import cut


# Amounts that are equal to the cent tie.
DOLLAR_RANK = Rank("dollar_weighted_score", "average_floor", digits=2)


def weighted(weights: Mapping[str, float], suffix: str = "") -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(f"{name}{suffix}") * weight
    return total


def dollar_weight(scores: DataFrame) -> DataFrame:
    """Anomaly score times payments, and its rank, of one row per provider."""
    weighted_scores = scores.withColumn("dollar_weighted_score", F.col("if_anomaly_score") * F.col("total_paid"))
    return global_ranks(weighted_scores, ["billing_npi"], {"dollar_rank": DOLLAR_RANK})


def cohort_risk(features: DataFrame) -> DataFrame:
    """Weighted sum of standardized cohort features, count of extreme ones (|z| > 2), and rank.

    ``features`` is read twice, the scores are written once before they are ranked.
    """
    fills = {name: 0.0 for name in COHORT_SCORED}
    z = preprocess(features, "billing_npi", COHORT_SCORED, logs=(), fills=fills)
    scored = extreme_count(z, COHORT_SCORED, 2, "hh_extreme_count").select(
        "billing_npi", "hh_extreme_count", F.round(weighted(COHORT_WEIGHTS), RANK_DIGITS).alias("hh_risk_score")
    )
    ranked = global_ranks(cut(scored), ["billing_npi"], {"hh_risk_rank": Rank("hh_risk_score", "average_floor")})
    return features.join(ranked, "billing_npi", "left")


def network_scores(networks: DataFrame, ind: DataFrame, org: DataFrame, deact: DataFrame, frequency: DataFrame) -> DataFrame:
    """Match columns of every official: name frequency, best tier, individual score and match flags."""
    scored = attach_lookup(networks, frequency, OFFICIAL, "name_freq_count", 0)
    scored = attach_lookup(scored, best_tier(ind), OFFICIAL, "leie_best_tier", 0)
    scored = scored.withColumn("name_freq_penalty", name_penalty("name_freq_count"))
    scored = scored.withColumns({
        "leie_ind_score": individual_score("leie_best_tier", "name_freq_penalty"),
        "has_leie_ind_match": (F.col("leie_best_tier") > 0).cast("int"),
    })
    scored = attach_match_flag(scored, org, OFFICIAL, "has_leie_org_match")
    scored = attach_match_flag(scored, deact, OFFICIAL, "has_deact_ind_match")
    return scored.withColumn("temporal_flag", F.col("has_deact_ind_match"))


def network_risk(networks: DataFrame, ind: DataFrame, org: DataFrame, deact: DataFrame, frequency: DataFrame) -> DataFrame:
    """Composite score and rank of multi-member officials. ``networks`` has the spending of ``attach_spending``."""
    scored = cut(network_scores(networks, ind, org, deact, frequency))
    ranked = percentile_ranks(scored, OFFICIAL, list(PERCENTILE_WEIGHTS))
    total = F.col("leie_ind_score") + weighted(FLAG_WEIGHTS) + weighted(PERCENTILE_WEIGHTS, "_pct")
    composed = cut(ranked.withColumn("risk_score", F.round(total, RANK_DIGITS)))
    return global_ranks(composed, OFFICIAL, {"risk_rank": Rank("risk_score", "average_floor")})


def flag_subset(risk: DataFrame, max_rank: int = 100) -> DataFrame:
    """Officials with any match, or of a high rank."""
    return risk.where(
        (F.col("has_leie_ind_match") == 1) | (F.col("has_leie_org_match") == 1)
        | (F.col("has_deact_ind_match") == 1) | (F.col("risk_rank") <= max_rank)
    )
