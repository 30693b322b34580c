"""Layer 2: the home-health cohort over all states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import code_lookup, count_of, flag, is_blank, prefix, ratio
from claimscope.functions.constants import CATEGORIES, CATEGORY_CODES, COHORT_PREFIXES, OTHER_CATEGORY, TAXONOMY_TYPES
from claimscope.operators import claims as C
from claimscope.operators import peers, profile, ranking, sets
from claimscope.operators.risk import cohort_risk
from claimscope.session import cut

MIX_COLUMNS = [f"pct_{name}" for name in [*CATEGORIES, OTHER_CATEGORY]]


def category_table(spark) -> DataFrame:
    """The fixed code categories as a table."""
    return spark.createDataFrame(
        [(code, name) for name, codes in CATEGORY_CODES.items() for code in codes], "hcpcs_code string, hh_category string"
    )


def taxonomy_type(df: DataFrame, names: Mapping[str, str] = TAXONOMY_TYPES, column: str = "primary_taxonomy") -> DataFrame:
    return df.withColumn("taxonomy_type", code_lookup(prefix(column, 4), names))


def extract_cohort_claims(claims: DataFrame, providers: DataFrame, prefixes: Sequence[str] = COHORT_PREFIXES) -> DataFrame:
    """Claims of the cohort with taxonomy, state and deactivation of the provider."""
    members = C.cohort(providers, prefixes).select(
        "npi", "primary_taxonomy", F.col("state").alias("provider_state"),
        flag(~is_blank(F.col("deactivation_date").cast("string"))).alias("is_deactivated"),
    )
    return C.enrich_claims(claims, members)


def cohort_prices(claims: DataFrame, min_peers: int = 3) -> DataFrame:
    """Sums, price, peer statistics and z-score per provider and code. The sums are written once."""
    return peers.peer_zscore(cut(C.provider_code(claims, ["hh_category"])), min_count=min_peers, ddof=1)


def cohort_features(claims: DataFrame, min_peers: int = 3) -> DataFrame:
    """One row per cohort provider. ``claims`` are categorized cohort claims, best a stored table."""
    codes = cut(C.provider_code(claims, ["hh_category"]))
    months = C.monthly_stats(C.provider_month(claims), ddof=1).select("billing_npi", "num_active_months", "monthly_paid_cv")
    attributes = C.constant_attrs(claims, "billing_npi", ["primary_taxonomy", "provider_state", "is_deactivated"])
    mix = C.category_mix(codes, amount="code_paid")
    mix = C.add_ratio(mix, "paid_skilled_nursing", "paid_aide", "nursing_to_aide_ratio")
    prices = peers.peer_zscore(codes, min_count=min_peers, ddof=1)
    rollup = peers.peer_rollup(prices, positive_only=True).select(
        "billing_npi", F.col("max_peer_zscore").alias("hh_max_peer_zscore"), F.col("mean_peer_zscore").alias("hh_mean_peer_zscore"),
    )
    features = C.assemble(
        C.provider_totals(codes), attributes, mix.select("billing_npi", *MIX_COLUMNS, "nursing_to_aide_ratio"),
        C.cohort_codes(codes), months, rollup,
    )
    return features.withColumn("num_hh_codes", F.coalesce("num_hh_codes", F.lit(0)))


def scored_cohort(claims: DataFrame, min_peers: int = 3) -> DataFrame:
    """Features, risk score and rank of the cohort."""
    return taxonomy_type(cohort_risk(cut(cohort_features(claims, min_peers))))


def cohort_overview(features: DataFrame) -> DataFrame:
    """Providers and payments per type, with a total."""
    by_type = features.where(F.col("taxonomy_type").isNotNull()).groupBy("taxonomy_type").agg(
        F.count(F.lit(1)).alias("num_providers"), F.sum("total_paid").alias("total_paid")
    )
    total = features.agg(
        F.lit("TOTAL").alias("taxonomy_type"), F.count(F.lit(1)).alias("num_providers"), F.sum("total_paid").alias("total_paid")
    )
    return by_type.unionByName(total)


def cohort_counts(claims: DataFrame, features: DataFrame) -> DataFrame:
    """One row: providers, states and distinct codes."""
    codes = claims.agg(F.countDistinct("hcpcs_code").alias("num_codes"))
    return sets.with_scalars(features.agg(
        F.count(F.lit(1)).alias("num_providers"), F.countDistinct("provider_state").alias("num_states")
    ), codes)


def cohort_states(features: DataFrame, n: int = 10) -> DataFrame:
    """The n states with the most providers."""
    states = features.where(F.col("provider_state").isNotNull()).groupBy("provider_state").agg(
        F.count(F.lit(1)).alias("num_providers"), F.sum("total_paid").alias("total_paid")
    )
    return ranking.sort_head(states, [F.desc("num_providers"), "provider_state"], n)


def cohort_top_codes(claims: DataFrame, n: int = 20) -> DataFrame:
    return ranking.top_k(C.code_summary(claims), "total_paid", n, "hcpcs_code", desc=True)


def code_mix(features: DataFrame) -> DataFrame:
    """Median, mean, p75, p95 and maximum of the category shares and of the nursing-to-aide ratio."""
    probabilities = {"p50": 0.5, "p75": 0.75, "p95": 0.95}
    return profile.numeric_profile(features, [*MIX_COLUMNS, "nursing_to_aide_ratio"], probabilities).select(
        "column", "p50", "mean", "p75", "p95", "max"
    )


def cohort_pricing_outliers(prices: DataFrame, features: DataFrame, threshold: float = 3, n: int = 20) -> DataFrame:
    """The n provider and code pairs of the highest peer z-score, with the provider's state."""
    top = ranking.sort_head(
        prices.where(F.col("peer_zscore") > threshold), [F.desc(F.round("peer_zscore", 9)), "billing_npi", "hcpcs_code"], n
    )
    return sets.attach_few(top, features, "billing_npi", ["provider_state"]).select(
        "billing_npi", "provider_state", "hcpcs_code", "ppc", "avg_ppc", "peer_zscore", "code_paid"
    )


def presence_crosstab(features: DataFrame, a: str = "pct_skilled_nursing", b: str = "pct_aide") -> DataFrame:
    """Providers by whether two shares are positive."""
    return features.groupBy((F.col(a) > 0).alias("has_a"), (F.col(b) > 0).alias("has_b")).agg(F.count(F.lit(1)).alias("n"))


def upcoding_signals(features: DataFrame, n: int = 15) -> DataFrame:
    """Providers of both nursing and aide services with the highest ratio of the two."""
    both = features.where((F.col("pct_skilled_nursing") > 0) & (F.col("pct_aide") > 0))
    return ranking.sort_head(both, [F.desc(F.round("nursing_to_aide_ratio", 9)), "billing_npi"], n).select(
        "billing_npi", "provider_state", "nursing_to_aide_ratio", "pct_skilled_nursing", "pct_aide", "total_paid",
        "paid_per_claim", "hh_risk_rank",
    )


def cohort_top(features: DataFrame, n: int = 30) -> DataFrame:
    return ranking.top_k(features, "hh_risk_rank", n, "billing_npi").select(
        "hh_risk_rank", "billing_npi", "provider_state", "taxonomy_type", "total_paid", "paid_per_claim", "hh_max_peer_zscore",
        "pct_skilled_nursing", "pct_aide", "nursing_to_aide_ratio", "pct_non_hh", "hh_extreme_count",
    )


def cross_reference(features: DataFrame, scores: DataFrame | None, k1: int = 50, k2: int = 200) -> DataFrame | None:
    """Cohort members in the top k2 of the general model, and whether they are in the cohort's top k1.

    Without general scores there is nothing to compare, and no table.
    """
    if scores is None:
        return None
    general = ranking.top_k(scores.select("billing_npi", "if_rank"), "if_rank", k2, "billing_npi")
    own = ranking.top_k(features.select("billing_npi", "hh_risk_rank"), "hh_risk_rank", k1, "billing_npi")
    marked = own.select("billing_npi", F.lit(1).alias("in_cohort_top"))
    return (
        features.select("billing_npi", "provider_state", "hh_risk_rank", "total_paid")
        .join(F.broadcast(general), "billing_npi").join(F.broadcast(marked), "billing_npi", "left")
        .withColumn("in_cohort_top", F.coalesce("in_cohort_top", F.lit(0)))
    )


def rare_expensive_codes(claims: DataFrame, max_providers: int = 5, min_paid: float = 100_000, n: int = 15) -> DataFrame:
    rare = C.code_summary(claims).where((F.col("num_providers") <= max_providers) & (F.col("total_paid") > min_paid))
    return ranking.sort_head(rare, [F.desc(F.round("avg_ppc", 9)), "hcpcs_code"], n)


def code_deep_dive(claims: DataFrame, features: DataFrame, code: str = "T1020", n: int = 15) -> DataFrame:
    """The n best paid providers of one code, with state and rank."""
    one = claims.where(F.col("hcpcs_code") == code).groupBy("billing_npi").agg(
        F.sum("total_paid").alias("total_paid"), F.sum("total_claims").alias("total_claims")
    ).withColumn("ppc", ratio("total_paid", "total_claims"))
    top = ranking.top_k(one, "total_paid", n, "billing_npi", desc=True)
    return sets.attach_few(top, features, "billing_npi", ["provider_state", "hh_risk_rank"])


def cohort_deactivated(features: DataFrame, n: int = 20) -> DataFrame:
    gone = features.where(F.col("is_deactivated") == 1)
    return ranking.top_k(gone, "total_paid", n, "billing_npi", desc=True).select(
        "billing_npi", "provider_state", "total_paid", "hh_risk_rank", "hh_max_peer_zscore"
    )


def cohort_summary(features: DataFrame, k: int = 30) -> DataFrame:
    """One row: size and payments of the cohort, share of the top k, extreme providers, medians."""
    base = features.agg(
        F.count(F.lit(1)).alias("num_providers"), F.countDistinct("provider_state").alias("num_states"),
        F.sum("total_paid").alias("total_paid"), count_of(F.col("hh_extreme_count") >= 2).alias("n_extreme"),
    )
    top = ranking.top_k(features, "hh_risk_rank", k, "billing_npi").agg(F.sum("total_paid").alias("top_paid"))
    quantiles = profile.numeric_quantiles(features, ["paid_per_claim", "hh_max_peer_zscore"], {"p50": 0.5})
    medians = quantiles.agg(*[
        F.max(F.when(F.col("column") == name, F.col("p50"))).alias(f"median_{name}")
        for name in ("paid_per_claim", "hh_max_peer_zscore")
    ])
    return sets.with_scalars(base, top, medians).withColumn("top_pct", 100 * ratio("top_paid", "total_paid"))


def state_concentration(features: DataFrame, k: int = 100) -> DataFrame:
    """Per state: providers, how many are in the top k, their payments, and the mean risk."""
    top = ranking.top_k(features, "hh_risk_rank", k, "billing_npi").select("billing_npi", F.lit(True).alias("_top"))
    marked = features.where(F.col("provider_state").isNotNull()).join(F.broadcast(top), "billing_npi", "left")
    return marked.groupBy(F.col("provider_state").alias("state")).agg(
        F.count(F.lit(1)).alias("n_providers"), F.count("_top").alias("n_in_top"),
        F.coalesce(F.sum(F.when(F.col("_top"), F.col("total_paid"))), F.lit(0.0)).alias("top_spending"),
        F.avg("hh_risk_score").alias("mean_risk_score"), F.sum("total_paid").alias("total_spending"),
    ).withColumns({
        "concentration_pct": 100 * ratio("n_in_top", "n_providers"),
        "spending_exposure_pct": F.when(
            F.col("total_spending") > 0, 100 * ratio("top_spending", "total_spending")
        ).otherwise(F.lit(0.0)),
    })


def with_defaults(claims: DataFrame, state: str) -> DataFrame:
    """Stored claims of an earlier one-state run, with the columns such runs may lack."""
    defaults = {"provider_state": F.lit(state), "is_deactivated": F.lit(0)}
    return claims.withColumns({name: value for name, value in defaults.items() if name not in claims.columns})


def compare_ranks(local: DataFrame, national: DataFrame) -> DataFrame:
    """Providers of a local run with both ranks and scores; a positive delta means more anomalous nationally."""
    own = local.select("billing_npi", F.col("hh_risk_rank").alias("local_rank"), F.col("hh_risk_score").alias("local_score"))
    wide = national.select(
        "billing_npi", F.col("hh_risk_rank").alias("national_rank"), F.col("hh_risk_score").alias("national_score"),
        "total_paid", "provider_state",
    )
    return own.join(wide, "billing_npi").withColumn("rank_delta", F.col("local_rank") - F.col("national_rank"))


def rank_stability(local: DataFrame, national: DataFrame, k: int = 30, wide_k: int = 100) -> dict[str, DataFrame]:
    """Local against national ranks: counts, best nationally ranked, movers, and the local top k."""
    compared = compare_ranks(local, national)
    top = {
        n: ranking.top_k(national, "hh_risk_rank", n, "billing_npi").select("billing_npi", F.lit(1).alias(f"in_top_{n}"))
        for n in (k, wide_k)
    }
    marked = compared
    for frame in top.values():
        marked = marked.join(F.broadcast(frame), "billing_npi", "left")
    marked = marked.withColumns({f"in_top_{n}": F.coalesce(f"in_top_{n}", F.lit(0)) for n in top})
    counts = sets.with_scalars(marked.agg(
        F.count(F.lit(1)).alias("matched"), *[F.sum(f"in_top_{n}").alias(f"in_top_{n}") for n in top]
    ), local.agg(F.count(F.lit(1)).alias("local_providers")))
    best_local = ranking.top_k(local, "hh_risk_rank", k, "billing_npi").select(
        "billing_npi", F.col("hh_risk_rank").alias("local_rank"), F.col("total_paid").alias("_local_paid")
    )
    stability = sets.attach_few(
        best_local, marked, "billing_npi", ["national_rank", "total_paid", *[f"in_top_{n}" for n in top]]
    ).withColumn(
        "total_paid", F.coalesce("total_paid", "_local_paid")
    ).drop("_local_paid")
    return {
        "counts": counts,
        "best": ranking.top_k(compared, "national_rank", 20, "billing_npi"),
        "movers": ranking.movers(compared, "billing_npi"),
        "stability": stability,
        "kept": stability.agg(*[F.coalesce(F.sum(f"in_top_{n}"), F.lit(0)).alias(f"still_top_{n}") for n in top]),
    }
