"""Layer 1: features, scores and reports for the providers of one state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.columns import age_years, count_of, multiple_of_100, prefix, ratio, whole_dollars
from claimscope.functions.constants import MODEL_FEATURES, PROFILE_FEATURES
from claimscope.operators import claims as C
from claimscope.operators import peers, profile, ranking, sets
from claimscope.operators.iforest import isolation_forest
from claimscope.operators.ranking import Rank
from claimscope.operators.risk import DOLLAR_RANK
from claimscope.operators.scale import bucket_number, lookup_join, summed_for
from claimscope.operators.standardize import extreme_count, preprocess
from claimscope.session import cut, cut_by, small_splits

FEATURE_COLUMNS = [
    "billing_npi", "total_paid", "total_claims", "total_beneficiaries", "num_hcpcs_codes", "num_active_months", "num_rows",
    "paid_per_claim", "claims_per_beneficiary", "paid_per_beneficiary",
    "pct_round_dollar", "pct_round_hundred", "pct_npi_mismatch", "revenue_concentration",
    "monthly_paid_cv", "max_monthly_paid", "max_peer_zscore", "mean_peer_zscore",
    "entity_type", "provider_age_years", "is_deactivated", "was_reactivated", "is_sole_proprietor", "is_org_subpart",
    "num_taxonomy_codes", "primary_taxonomy",
]


def profile_claims(claims: DataFrame, top_codes: int = 20, top_providers: int = 10, first_rows: int = 5) -> dict[str, DataFrame]:
    """Profile tables of the spending data, over all rows, and its first rows.

    The claims are read four times: once for all plain aggregates, once for the values of the identifiers, once for the
    numbers' quantiles, and once for distinct numbers and months.
    """
    numbers, texts = ["total_unique_beneficiaries", "total_claims", "total_paid"], ["billing_npi", "servicing_npi", "hcpcs_code"]
    conditions = {
        "same_npi": F.col("billing_npi") == F.col("servicing_npi"), "whole_dollars": whole_dollars("total_paid"),
        "multiples_of_100": multiple_of_100("total_paid"),
    }
    whole = cut(profile.one_pass(claims, numbers, ["claim_from_month"], conditions))
    values = cut(profile.value_counts(claims, texts))
    rates = whole.select(F.inline("rates"))
    quantiles = profile.numeric_quantiles(claims, numbers)
    rest = [name for name in claims.columns if name not in texts]

    def lengths(name: str) -> DataFrame:
        """Ids are counted per value already; nulls are one more length."""
        known = values.where(F.col("column") == name).groupBy(F.length("value").alias("length")).agg(F.sum("n").alias("n"))
        nulls = whole.select(F.inline("nulls")).where((F.col("column") == name) & (F.col("null_count") > 0))
        return known.union(nulls.select(F.lit(None).cast("int"), F.col("null_count")))

    def frequent(name: str, n: int) -> DataFrame:
        top = values.where(F.col("column") == name).orderBy(F.desc("n"), "value").limit(n)
        return top.select(F.col("value").alias(name), "n", (100 * ratio(F.col("n"), whole.select("rows").scalar())).alias("pct"))

    return {
        "nulls": whole.select(F.inline("nulls")),
        "billing_lengths": lengths("billing_npi"),
        "servicing_lengths": lengths("servicing_npi"),
        "code_lengths": lengths("hcpcs_code"),
        "dates": whole.select(F.inline("dates")).drop("column"),
        "cardinality": values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")).union(profile.cardinality(claims.select(*rest))),
        "numbers": whole.select(F.inline("numbers")).join(quantiles, "column", "left"),
        **{name: rates.where(F.col("column") == name).drop("column") for name in conditions},
        "top_codes": frequent("hcpcs_code", top_codes),
        "top_providers": frequent("billing_npi", top_providers),
        "head": claims.limit(first_rows),
    }


def provider_features(
    claims: DataFrame, providers: DataFrame, deactivated: DataFrame, as_of: str, min_peers: int = 5,
) -> DataFrame:
    """The 26 feature columns of every given provider that bills.

    ``providers`` is the registry scoped to a state, one row per npi. The claims are read once: their sums per code and per
    month are one table, bucketed by provider, and one aggregation of it, without a shuffle, gives all volume columns. Registry columns join the
    finished provider rows.
    """
    volume = provider_volume(provider_sums_of(claims, providers), min_peers)
    registry = C.registry_flags(providers, deactivated).withColumn(
        "provider_age_years", age_years("enumeration_date", as_of)
    ).withColumnRenamed("npi", "billing_npi")
    return volume.join(registry, "billing_npi").select(*FEATURE_COLUMNS)


def provider_sums_of(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Stored sums per code and per month of the given providers, bucketed by provider."""
    ids = providers.select(F.col("npi").alias("billing_npi"))
    sums = summed_for(claims, ids, "billing_npi", C.provider_sums)[0]
    with small_splits(claims.sparkSession):
        return cut_by(sums, "billing_npi", bucket_number(claims))


def provider_volume(sums: DataFrame, min_peers: int) -> DataFrame:
    """All columns of a provider that come from its sums. Peer statistics are joined by code; month rows have no code, and no z-score."""
    stats = peers.min_peers(peers.peer_stats(sums.where("by_code"), ddof=0), min_peers)
    priced = lookup_join(sums, stats, "hcpcs_code", "left", spread_by=["billing_npi", "claim_from_month"])
    scored = priced.withColumn("peer_zscore", F.when(F.col("by_code"), peers.deviation_from_peers()))
    return C.with_intensity(scored.groupBy("billing_npi").agg(
        *C.total_aggregates(), *C.pattern_aggregates(), *C.concentration_aggregates(), *C.monthly_aggregates(ddof=0), *peers.rollup_aggregates(),
    ))


def feature_summary(features: DataFrame) -> DataFrame:
    """Median, mean and maximum of the numeric features."""
    return profile.numeric_profile(features, PROFILE_FEATURES, {"p50": 0.5}).select("column", "p50", "mean", "max")


def zscore_baseline(features: DataFrame, threshold: float = 3) -> DataFrame:
    """Number of extreme features per provider, and its rank (ties share the best place)."""
    counted = extreme_count(preprocess(features), MODEL_FEATURES, threshold, "zscore_count").select("billing_npi", "zscore_count")
    return ranking.global_ranks(cut(counted), ["billing_npi"], {"zscore_rank": Rank("zscore_count")})


def score_providers(features: DataFrame, trees: int = 200, psi: int = 256, seed: int = 42, threshold: float = 3) -> DataFrame:
    """Features with z-score count, forest score, dollar-weighted score and the rank of each.

    All three ranks come from one pass. ``features`` should be a stored table: it is read several times.
    """
    z = cut(preprocess(features))
    counted = extreme_count(z, MODEL_FEATURES, threshold, "zscore_count").select("billing_npi", "zscore_count")
    forest = isolation_forest(z, "billing_npi", MODEL_FEATURES, trees, psi, seed)
    paid = features.select("billing_npi", "total_paid")
    base = cut(C.assemble(counted, forest, paid).withColumn("dollar_weighted_score", F.col("if_anomaly_score") * F.col("total_paid")))
    ranked = ranking.global_ranks(base, ["billing_npi"], {
        "if_rank": Rank("if_anomaly_score", "average_floor"), "zscore_rank": Rank("zscore_count"), "dollar_rank": DOLLAR_RANK,
    })
    return features.join(ranked.drop("total_paid"), "billing_npi")


def score_quantiles(scores: DataFrame, column: str = "if_anomaly_score") -> DataFrame:
    probabilities = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    return profile.numeric_profile(scores, [column], probabilities)


def zscore_distribution(scores: DataFrame) -> DataFrame:
    """Providers per number of extreme features, their share, and how many have at least as many."""
    counts = profile.frequency(scores, "zscore_count")
    upwards = Window.orderBy(F.desc("zscore_count")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of at most 22 rows
    return counts.withColumn("n_at_least", F.sum("n").over(upwards))


def entity_counts(features: DataFrame) -> DataFrame:
    return profile.frequency(features, "entity_type")


def top_anomalies(scores: DataFrame, by: str = "if_rank", k: int = 50) -> DataFrame:
    """The k providers of the best rank in ``if_rank``, ``zscore_rank`` or ``dollar_rank``."""
    columns = [
        "billing_npi", "if_rank", "zscore_rank", "dollar_rank", "if_anomaly_score", "zscore_count", "total_paid", "total_claims",
        "paid_per_claim", "max_peer_zscore", "num_hcpcs_codes", "num_taxonomy_codes", "pct_round_dollar", "monthly_paid_cv",
        "is_deactivated", "entity_type",
    ]
    return ranking.top_k(scores, by, k, "billing_npi").select(*[c for c in columns if c in scores.columns])


def feature_contributions(scores: DataFrame, by: str = "if_rank", k: int = 20, n: int = 5) -> DataFrame:
    """The n most extreme features of each of the k top providers, with |z| and the raw value."""
    z = preprocess(scores)
    chosen = ranking.top_k(scores, by, k, "billing_npi")
    features = ranking.top_features(
        z.join(F.broadcast(chosen.select("billing_npi")), "billing_npi", "left_semi"), "billing_npi", MODEL_FEATURES, n
    )
    raw = chosen.select("billing_npi", by, *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES])
    long = raw.unpivot(["billing_npi", by], MODEL_FEATURES, "feature", "raw_value")
    return features.join(F.broadcast(long), ["billing_npi", "feature"])


def topk_agreement(scores: DataFrame, ranks: Sequence[str], ks: Sequence[int] = (20, 50, 100, 200), id_col: str = "billing_npi") -> DataFrame:
    """For each k, how many ids are in the top k of each pair of rankings, and of all."""
    places = [ranking.positions(scores, rank, max(ks), id_col, f"p_{rank}") for rank in ranks]
    joined = places[0]
    for other in places[1:]:
        joined = joined.join(other, id_col, "full")
    sets_of_ranks = [(a, b) for i, a in enumerate(ranks) for b in ranks[i + 1:]]
    sets_of_ranks += [tuple(ranks)] if len(ranks) > 2 else []
    rows = joined.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))

    def together(names: Sequence[str]) -> Column:
        inside = F.lit(True)
        for name in names:
            inside = inside & F.coalesce(F.col(f"p_{name}") <= F.col("k"), F.lit(False))
        return count_of(inside)

    counts = {"_and_".join(names): together(names) for names in sets_of_ranks}
    return rows.groupBy("k").agg(*[value.alias(name) for name, value in counts.items()]).withColumns({
        f"pct_{name}": 100 * ratio(name, "k") for name in counts
    })


def deactivated_summary(features: DataFrame) -> DataFrame:
    """One row: deactivated providers, what they were paid, and how many were reactivated."""
    gone = F.col("is_deactivated") == 1
    extra = [count_of(gone & (F.col("was_reactivated") == 1)).alias("also_reactivated")] if "was_reactivated" in features.columns else []
    return features.agg(
        count_of(gone).alias("num_deactivated"),
        F.coalesce(F.sum(F.when(gone, F.col("total_paid"))), F.lit(0.0)).alias("total_paid"), *extra,
    )


def deactivated_with_spending(features: DataFrame, n: int = 20) -> DataFrame:
    columns = [
        "billing_npi", "total_paid", "total_claims", "paid_per_claim", "max_peer_zscore", "num_hcpcs_codes",
        "if_rank", "zscore_rank", "provider_age_years", "num_taxonomy_codes",
    ]
    gone = features.where(F.col("is_deactivated") == 1)
    return ranking.sort_head(gone, [F.desc("total_paid"), "billing_npi"], n).select(*[c for c in columns if c in features.columns])


def group_lift(df: DataFrame, group: str | Column, rank: str, k: int = 200, n: int = 15, id_col: str = "billing_npi") -> DataFrame:
    """The n most frequent groups among the top k, and their share against all rows.

    As in the report it serves, a group's share of all rows counts only if it is one of the n largest groups, else 0.
    """
    grouped = df.withColumn("grp", group if isinstance(group, Column) else F.col(group))
    base = profile.frequency(grouped, "grp", n).select("grp", F.col("pct").alias("base_pct"))
    top = profile.frequency(ranking.top_k(grouped, rank, k, id_col), "grp", n)
    return top.join(F.broadcast(base), "grp", "left").withColumn("base_pct", F.coalesce("base_pct", F.lit(0.0))).withColumn(
        "lift", ratio("pct", "base_pct")
    )


def specialty_lift(scores: DataFrame, rank: str = "if_rank", k: int = 200, n: int = 15) -> DataFrame:
    return group_lift(scores, prefix("primary_taxonomy", 3), rank, k, n)


def compare_entities(scores: DataFrame, rank: str = "if_rank", k: int = 200) -> DataFrame:
    """Persons against organisations: counts, share in the top k, medians and mean."""
    compared = profile.compare_groups(
        scores, "entity_type",
        medians={"median_paid": "total_paid", "median_ppc": "paid_per_claim", "median_peer_z": "max_peer_zscore"},
        means={"mean_paid": "total_paid"},
    )
    top = profile.frequency(ranking.top_k(scores, rank, k, "billing_npi"), "entity_type")
    top = top.select("entity_type", F.col("n").alias("n_top"), F.col("pct").alias("pct_top"))
    joined = compared.join(F.broadcast(top), "entity_type", "left")
    return joined.withColumns({"n_top": F.coalesce("n_top", F.lit(0)), "pct_top": F.coalesce("pct_top", F.lit(0.0))})


def coverage(claims: DataFrame, features: DataFrame, rank: str | None = None, k: int = 200) -> DataFrame:
    """One row: national providers, providers covered, both rates, and what the top k were paid."""
    national = C.distinct_ids(claims)
    covered = features.agg(F.count(F.lit(1)).alias("covered"), F.sum("total_paid").alias("total_paid"))
    row = sets.with_scalars(covered, national)
    row = row.withColumns({
        "dropped": F.col("national_providers") - F.col("covered"),
        "coverage_pct": 100 * ratio("covered", "national_providers"),
    }).withColumn("drop_pct", 100 * ratio("dropped", "national_providers"))
    if rank is None:
        return row
    top = ranking.top_k(features, rank, k, "billing_npi").agg(
        F.count(F.lit(1)).alias("top_providers"), F.sum("total_paid").alias("top_paid")
    )
    return sets.with_scalars(row, top).withColumn("top_pct", 100 * ratio("top_paid", "total_paid"))


def agreement_ids(scores: DataFrame, ranks: Sequence[str], k: int) -> DataFrame:
    """Ids in the top k of every given ranking."""
    return sets.intersect_ids(*[ranking.top_k(scores, rank, k, "billing_npi").select("billing_npi") for rank in ranks])
