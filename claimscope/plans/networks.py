"""Layer 3: networks of organisations under one authorized official."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import binned
from claimscope.functions.constants import SIZE_BINS, SPENDING_TIERS, TIER_LABELS
from claimscope.operators import claims as C
from claimscope.operators import matching as M
from claimscope.operators import networks as N
from claimscope.operators import ranking, risk, sets
from claimscope.operators.networks import OFFICIAL, Networks
from claimscope.session import cut


def build_networks(orgs: DataFrame) -> Networks:
    """Networks of flagged organisations. Used columns, counts, members and states are written once; later steps read them."""
    used = ["ao_last", "ao_first", "ao_middle", "ao_phone", "npi", "state", "city", "address_line1", "zip5"]
    flags = ["is_deactivated", "is_reactivated", "is_hh", "is_subpart_flag"]
    orgs = cut(N.named(orgs).select(*used, *flags))  # the pruned rows are read several times, the registry once
    networks = N.build_networks(orgs, cut(N.all_officials(orgs)))
    return replace(networks, members=cut(networks.members), states=cut(networks.states))


def match_exclusions(networks: Networks, orgs: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiered matches of excluded persons, and matches of excluded organisations. The lists are written once: the matches read them five times."""
    persons, businesses = (cut(entries) for entries in M.split_exclusions(exclusions))
    return M.match_individuals_tiered(networks, persons), M.match_organisations(networks, orgs, businesses)


def match_deactivated(networks: Networks, deactivated_persons: DataFrame) -> DataFrame:
    return M.match_deactivated(networks.states, deactivated_persons)


def spending_exposure(claims: DataFrame, networks: Networks) -> DataFrame:
    """Spending per organisation of a multi-member official."""
    return C.exposure_by_npi(claims, N.member_ids(networks.members))


def network_risk(
    networks: Networks, ind: DataFrame, org: DataFrame, deact: DataFrame, exposure: DataFrame, frequency: DataFrame,
) -> DataFrame:
    spending = N.exposure_by_official(exposure, networks.members)
    return risk.network_risk(N.attach_spending(networks.officials, spending), ind, org, deact, frequency)


def network_flags(scored: DataFrame, max_rank: int = 100) -> DataFrame:
    return risk.flag_subset(scored, max_rank)


def size_bins(df: DataFrame, col: str = "npi_count", edges: Sequence = tuple(SIZE_BINS)) -> DataFrame:
    """Officials per size bin, with their share."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = df.groupBy(binned(col, edges).alias("bin")).agg(F.count(F.lit(1)).alias("num_officials"))
    return counts.withColumn("pct", 100 * F.try_divide(F.col("num_officials").cast("double"), total))


def amount_tiers(df: DataFrame, col: str = "total_spending", edges: Sequence = tuple(SPENDING_TIERS)) -> DataFrame:
    """Officials and spending per spending tier."""
    return df.groupBy(binned(col, edges).alias("spending_tier")).agg(
        F.count(F.lit(1)).alias("num_officials"), F.sum(col).alias("total_spending")
    )


def overview(everyone: DataFrame, scored: DataFrame, orgs: DataFrame) -> DataFrame:
    """One row: organisations, officials, multi-member officials and their spending."""
    return sets.with_scalars(
        scored.agg(F.count(F.lit(1)).alias("num_multi"), F.sum("total_spending").alias("total_spending")),
        orgs.agg(F.count(F.lit(1)).alias("num_orgs")), everyone.agg(F.count(F.lit(1)).alias("num_officials")),
    )


def top_officials(scored: DataFrame, n: int = 30) -> DataFrame:
    return ranking.top_k(scored, "risk_rank", n, OFFICIAL).select(
        "risk_rank", *OFFICIAL, "npi_count", "num_states", "num_deactivated", "has_leie_ind_match", "leie_best_tier",
        "has_leie_org_match", "total_spending", "risk_score",
    )


def official_detail(scored: DataFrame, orgs: DataFrame, exposure: DataFrame, officials: int = 5, n: int = 10) -> DataFrame:
    """The first n organisations, by state, of each of the top officials, with spending."""
    top = ranking.top_k(scored, "risk_rank", officials, OFFICIAL).select(*OFFICIAL, "risk_rank")
    theirs = orgs.join(F.broadcast(top), OFFICIAL)
    detail = ranking.first_per_key(theirs, OFFICIAL, [F.col("state"), F.col("npi")], n)
    spent = exposure.select(F.col("billing_npi").alias("npi"), "total_paid")
    return sets.attach_few(detail, spent, "npi", ["total_paid"]).select(
        "risk_rank", *OFFICIAL, "npi", "state", "org_name", "total_paid", "is_deactivated", "is_hh"
    )


def with_lists(officials: DataFrame, lists: DataFrame, item: str, out: str, size: int) -> DataFrame:
    """The first items of a list per official, for a report of a few officials."""
    first = ranking.first_per_key(lists.join(F.broadcast(officials.select(*OFFICIAL)), OFFICIAL, "left_semi"), OFFICIAL, [item], size)
    short = first.groupBy(*OFFICIAL).agg(F.sort_array(F.collect_list(item)).alias(out))
    return officials.join(short, OFFICIAL, "left")


def multi_state(scored: DataFrame, networks: Networks, min_states: int = 3, n: int = 30, show: int = 8) -> DataFrame:
    """Officials in many states, with the first of them."""
    wide = scored.where(F.col("num_states") >= min_states)
    top = ranking.sort_head(wide, [F.desc("num_states"), *OFFICIAL], n).select(*OFFICIAL, "npi_count", "num_states", "total_spending")
    return with_lists(top, networks.states, "state", "states", show)


def exclusion_tiers(matches: DataFrame) -> DataFrame:
    """Officials per tier, all tiers present, with a label."""
    tiers = matches.sparkSession.createDataFrame(list(TIER_LABELS.items()), "tier int, label string")
    return tiers.join(N.tier_counts(matches), "tier", "left").withColumn("num_officials", F.coalesce("num_officials", F.lit(0)))


def best_matches(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """One match per official, of the best tier, with spending, frequency, score and rank."""
    best = ranking.keep_first(
        matches.select(*OFFICIAL, "tier", "excltype", "excldate"), OFFICIAL, ["tier", "excldate", "excltype"]
    )
    return best.join(scored.select(
        *OFFICIAL, "total_spending", "npi_count", "num_states", "risk_rank", "name_freq_count", "name_freq_penalty", "leie_ind_score",
    ), OFFICIAL, "left")


def tier_table(matches: DataFrame, scored: DataFrame, tiers: Sequence[int], n: int = 10) -> DataFrame:
    """The n officials of the given tiers with the most spending."""
    chosen = best_matches(matches, scored).where(F.col("tier").isin(list(tiers)))
    return ranking.top_k(chosen, "total_spending", n, OFFICIAL, desc=True)


def organisation_matches(matches: DataFrame, n: int = 20) -> DataFrame:
    return ranking.sort_head(matches, ["npi"], n).select("npi", "leie_busname", "org_name", "state", "match_type")


def deactivated_officials(matches: DataFrame, scored: DataFrame, n: int = 20) -> DataFrame:
    """Officials with a deactivated person of their name, by spending."""
    first = ranking.keep_first(
        matches.select(*OFFICIAL, "deactivation_date", "deact_npi"), OFFICIAL,
        [F.col("deactivation_date").asc_nulls_last(), F.col("deact_npi")],
    ).drop("deact_npi")
    joined = first.join(scored.select(*OFFICIAL, "total_spending", "npi_count", "num_states", "risk_rank"), OFFICIAL, "left")
    return ranking.top_k(joined, "total_spending", n, OFFICIAL, desc=True)


def cycling(scored: DataFrame, n: int = 20) -> DataFrame:
    return ranking.sort_head(N.burn_and_churn(scored), [F.desc("num_deactivated"), *OFFICIAL], n).select(
        *OFFICIAL, "num_active", "num_deactivated", "npi_count", "num_states", "total_spending"
    )


def clustered_addresses(scored: DataFrame, k: int = 3, n: int = 20) -> DataFrame:
    """Officials with k or more organisations at one address."""
    close = scored.where((F.col("same_address_count") >= k) & (F.col("npi_count") >= k))
    return ranking.sort_head(close, [F.desc("same_address_count"), *OFFICIAL], n).select(
        *OFFICIAL, "same_address_count", "npi_count", "same_address_ratio", "total_spending"
    )


def cohort_multi_state(
    scored: DataFrame, orgs: DataFrame, cohort: DataFrame | None = None, min_states: int = 2, n: int = 20, show: int = 10,
) -> DataFrame:
    """Officials with home-health organisations in several states; with cohort scores, also how many are ranked and the first ranks."""
    wide = scored.where((F.col("has_hh_taxonomy") == 1) & (F.col("num_states") >= min_states))
    top = ranking.top_k(wide, "total_spending", n, OFFICIAL, desc=True).select(
        *OFFICIAL, "npi_count", "num_states", "num_hh", "total_spending"
    )
    if cohort is None:
        return top
    theirs = orgs.where(F.col("is_hh") == 1).join(F.broadcast(top.select(*OFFICIAL)), OFFICIAL, "left_semi")
    ranked = theirs.select(*OFFICIAL, F.col("npi").alias("billing_npi")).join(
        cohort.select("billing_npi", "hh_risk_rank"), "billing_npi"
    )
    counted = top.join(ranked.groupBy(*OFFICIAL).agg(F.count(F.lit(1)).alias("num_ranked")), OFFICIAL, "left")
    return with_lists(counted, ranked, "hh_risk_rank", "hh_ranks", show)


def top_spending(scored: DataFrame, n: int = 10) -> DataFrame:
    return ranking.top_k(scored, "total_spending", n, OFFICIAL, desc=True).select(
        *OFFICIAL, "total_spending", "npi_count", "num_states", "risk_rank"
    )


def section_totals(
    scored: DataFrame, organisation: DataFrame, deactivated: DataFrame, min_states: int = 3, cluster: int = 3, cohort_states: int = 2,
) -> DataFrame:
    """One row: how many officials each section of the report is about, and how many matches there are."""
    counts = {
        "num_multi_state": F.col("num_states") >= min_states,
        "num_cycling": (F.col("num_deactivated") > 0) & (F.col("npi_count") > F.col("num_deactivated")),
        "num_clustered": (F.col("same_address_count") >= cluster) & (F.col("npi_count") >= cluster),
        "num_cohort_multi_state": (F.col("has_hh_taxonomy") == 1) & (F.col("num_states") >= cohort_states),
    }
    return scored.agg(*[F.count_if(condition).alias(name) for name, condition in counts.items()]).select(
        "*", organisation.agg(F.count(F.lit(1))).scalar().alias("num_org_matches"),
        organisation.agg(F.count_distinct("npi")).scalar().alias("num_matched_orgs"),
        deactivated.agg(F.count(F.lit(1))).scalar().alias("num_deactivated_matches"),
    )
